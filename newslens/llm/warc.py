"""WARC records in ZIP-packaged archives: writer and range reader (operator 10).

Writing: payloads are digested (SHA-1); of records with equal payloads the one with
the largest id is a response, the others revisit it.  Tasks write archives of bounded
size into the shared folder.  An archive is a ZIP file with stored members: a
`archive/data.warc.gz` with one gzip member per record, an index `indexes/index.cdx`
with a line `id offset length type` per record, and a `datapackage.json`.  It is
written under a hidden name and then moved.  Which archives count is said by the
committed manifest (`uri, records`), so what a failed or repeated attempt has left is
never read.

Reading: a task reads an archive's tail, finds the end-of-central-directory record
(and the ZIP64 one, where sizes, offsets or counts do not fit), parses the central
directory, locates the stored members, range-reads the index, and then range-reads
each record; nothing is unpacked to disk.  Index entries are dealt out to tasks before
records are read, so a large archive is read by many tasks.

Files are opened with pyarrow's file systems (local, hdfs, s3, gs), by the URI scheme
of the shared folder.

Nulls: a null payload is an empty one; a null id is written as an empty id and read
back as null; a null URL is empty.  Empty payloads share a digest like any other.
Repeated rows with the largest id are all responses.  An empty table gives no archives
and no rows.  Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.llm.common import Scratch

# ZIP record signatures and sizes, WARC line ends.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
LINE = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"
ARCHIVE_BYTES = 16 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# --- ZIP ---------------------------------------------------------------------------------
def zip_bytes(members: list[tuple[str, bytes]], always64: bool = False) -> Iterator[bytes]:
    """A ZIP file of stored members, in pieces; ZIP64 records where a field is too small (or always)."""
    at, entries = 0, []
    for name, data in members:
        crc, n, raw = zlib.crc32(data), len(data), name.encode()
        big = always64 or n >= FULL32
        extra = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        head = LOCAL + struct.pack("<HHHHHIIIHH", 45 if big else 20, 0x800, 0, 0, 33, crc, FULL32 if big else n, FULL32 if big else n, len(raw), len(extra)) + raw + extra
        entries.append((raw, crc, n, at))
        at += len(head) + n
        yield head
        yield data
    start = at
    for raw, crc, n, offset in entries:
        wide = [v for v in (n, n, offset) if always64 or v >= FULL32]
        extra = struct.pack("<HH", 1, 8 * len(wide)) + struct.pack(f"<{len(wide)}Q", *wide) if wide else b""
        small = lambda v: FULL32 if always64 or v >= FULL32 else v
        head = CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 33, crc, small(n), small(n), len(raw), len(extra), 0, 0, 0, 0, small(offset)) + raw + extra
        at += len(head)
        yield head
    count, size = len(entries), at - start
    if always64 or count >= FULL16 or start >= FULL32 or size >= FULL32:
        yield END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, start)
        yield LOCATOR64 + struct.pack("<IQI", 0, at, 1)
        count, size, start = FULL16, FULL32, FULL32
    yield END + struct.pack("<HHHHIIH", 0, 0, count, count, size, start, 0)


def zip_members(read, size: int) -> dict[str, tuple[int, int]]:
    """Offset and length of each stored member's bytes.  `read(offset, length)` reads a range of the file of `size` bytes."""
    tail_at = max(0, size - (FULL16 + 22 + 20))
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)  # the signature stood in the comment
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, count, length, start = struct.unpack_from("<HHHHII", tail, at + 4)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        where = struct.unpack_from("<Q", tail, at - 20 + 8)[0]
        end64 = read(where, 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, p, found = read(start, length), 0, {}
    for _ in range(count):
        if directory[p : p + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method, _, _, _, packed, plain, n, m, k, _, _, _, offset = struct.unpack_from("<HHHHIIIHHHHHII", directory, p + 8)
        name, extra = directory[p + 46 : p + 46 + n], directory[p + 46 + n : p + 46 + n + m]
        e = 0
        while e + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # 64-bit values of the fields that are full, in this order
                values = iter(struct.unpack_from(f"<{width // 8}Q", extra, e + 4))
                plain, packed, offset = (next(values) if v == FULL32 else v for v in (plain, packed, offset))
            e += 4 + width
        p += 46 + n + m + k
        if method or flags & 1:
            continue  # compressed or encrypted: not a stored member
        local = read(offset, 30)
        if local[:4] != LOCAL:
            raise ValueError("broken local header")
        n, m = struct.unpack_from("<HH", local, 26)
        found[name.decode("utf-8", "replace")] = (offset + 30 + n + m, packed)
    return found


# --- WARC --------------------------------------------------------------------------------
def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK" + LINE + b"Content-Type: text/html; charset=utf-8" + LINE + LINE
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = b"WARC/1.1" + LINE + b"".join(f"{k}: {v}".encode() + LINE for k, v in fields) + LINE
    return gzip.compress(head + block + LINE + LINE, 5, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes | None]:
    """Named fields and the payload (None of a revisit) of one gzip member; a response's payload must match its digest."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(LINE + LINE)
    version, *lines = head.split(LINE)
    if not version.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields = {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if fields["warc-type"] == "revisit":
        return fields, None
    payload = block.partition(LINE + LINE)[2]
    if f"sha1:{payload_digest(payload)}" != fields["warc-payload-digest"]:
        raise ValueError("a payload differs from its digest")
    return fields, payload


def _id(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def write_archives(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every row as a record; a DataFrame of the archives (uri, records) that writes them when it is run.

    Payloads of fewer than `least` bytes are always responses.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(url_col, F.lit("")).alias("url"), payload.alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    # narrow pass: a digest's largest id, combined before the shuffle
    latest = rows.where(F.octet_length("payload") >= least).groupBy("sha1").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = rows.join(latest, "sha1", "left").withColumn("refers_to", F.when((F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        body, index, at, done = [], [], 0, []

        def flush() -> None:
            nonlocal body, index, at
            package = json.dumps({"profile": "data-package", "resources": [{"path": WARC}, {"path": INDEX}]}).encode()
            own = uuid.uuid4().hex
            with system.open_output_stream(f"{root}/.{own}") as out:
                for piece in zip_bytes([(WARC, b"".join(body)), (INDEX, "".join(index).encode()), (PACKAGE, package)]):
                    out.write(piece)
            system.move(f"{root}/.{own}", f"{root}/{own}.wacz")
            done.append((f"{folder}/{own}.wacz", len(index)))
            body, index, at = [], [], 0

        for batch in batches:
            for page_id, url, payload, sha1, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                member = record(page_id, url, payload, base64.b32encode(sha1).decode(), refers_to)
                index.append(f"{'-' if page_id is None else page_id} {at} {len(member)} {'response' if refers_to is None else 'revisit'}\n")
                body.append(member)
                at += len(member)
                if at >= archive_bytes:
                    flush()
        if body:
            flush()
        yield pa.RecordBatch.from_pydict({"uri": pa.array([d[0] for d in done], pa.string()), "records": pa.array([d[1] for d in done], pa.int64())})

    return told.select("page_id", "url", "payload", "sha1", "refers_to").mapInArrow(write, "uri string, records long")


def index_entries(archives: DataFrame) -> DataFrame:
    """uri, position and length of each record in the archive file: from the central directory and the index member."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                system, path = opened(uri)
                with system.open_input_file(path) as file:
                    members = zip_members(lambda at, n, file=file: file.read_at(n, at), file.size())
                    start, length = members[INDEX]
                    lines = [x.split(" ") for x in file.read_at(length, start).decode().splitlines()]
                base = members[WARC][0]
                yield pa.RecordBatch.from_pydict({"uri": pa.array([uri] * len(lines), pa.string()), "position": pa.array([base + int(x[1]) for x in lines], pa.int64()), "length": pa.array([int(x[2]) for x in lines], pa.int64())})

    return archives.select("uri").mapInArrow(entries, "uri string, position long, length long")


def read_records(entries: DataFrame, with_payload: bool = True) -> DataFrame:
    """Range-read each entry: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload (null of a revisit)."""
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary" * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uri, file = None, None
            for at in range(0, batch.num_rows, 256):
                out = []
                for name, position, length in zip(*(c.to_pylist() for c in batch.slice(at, 256).select(["uri", "position", "length"]).columns), strict=True):
                    if name != uri:
                        system, path = opened(name)
                        uri, file = name, system.open_input_file(path)
                    fields, payload = parse(file.read_at(length, position))
                    out.append((_id(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"]), _id(fields.get("warc-refers-to")), payload))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                names = [x.strip().split(" ")[0] for x in schema.split(",")]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    return entries.mapInArrow(read, schema)


def round_trip(pages: DataFrame, least: int = 0, with_payload: bool = False, **columns: str) -> DataFrame:
    """Write the rows to archives in the shared folder and read every record back."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    archives = scratch.table(write_archives(pages, scratch.path("archives"), least, **columns), "written")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = index_entries(archives.repartition(tasks, "uri"))
    return read_records(entries.repartition(tasks, F.xxhash64("uri", F.expr("position div 1048576"))).sortWithinPartitions("uri", "position"), with_payload)
