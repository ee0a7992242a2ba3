"""Token-id files: frequency-ranked ids in byte-aligned codes with separate control bytes (operator 13).

Encoding.  Ids come from the tokenizers library.  A text is cut where its vocabulary's rules
never reach across: at blanks, and in plain words (ASCII and Latin-1 letters, digits, signs), which are
lower-cased, also where letters and signs meet and at every digit.  Such a chunk is one
word of the library's model, which encodes it; all other words go through the whole
library.  Distinct chunks are encoded once and kept, and one text of every slice is
compared with the library's result for the whole text.

Order.  The ids of all texts are written to a table and counted; id number r by falling
frequency (ties: smaller id) is coded as r, so the frequent ids take one byte.  Documents are dealt into ranges of the id at quantiles of all ids; an id so frequent
that it fills whole ranges is dealt over those.  Each range is written as one file, in order.

File format, little endian.  A file is a sequence of segments of whole documents:
header `magic, documents, tokens, control bytes, data bytes, crc32 of the rest`; a byte per
document (1: it has an id), its id (int64), its number of tokens (uint32); the control bytes of
all documents; their data bytes.  A control byte holds the lengths less one of four
codes, two bits each, lowest first; a document begins with a new control byte.  Data bytes are
the low 1 to 4 bytes of each rank.  `ids.u32` beside the files lists the ids by rank.  Which
files count, and their segments, is said by the committed manifest (part, file, at, bytes,
documents, tokens), so what a failed or repeated attempt has left is never read.

Reading.  Segments are dealt out to tasks; each is one range read.  The lengths of a control
byte's codes come from a table of 256 rows, the ranks are gathered from the data with numpy,
and a table turns them into ids.

Nulls: a null text is empty; rows without an id come first.  An empty text has the end
id only.  Rows of one id stand next to each other, in no set order beyond their number
of tokens.  An empty table gives no files and no rows.  Other columns are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslens.llm.common import Scratch, distinct_words, in_arrow, spans, text_bytes, text_slices, worker_cache
from newslens.llm.warc import opened

# Fixed values of the format.
MAGIC = b"FRV1"
HEADER = "<4sIQQQI"
RANKS = "ids.u32"
SEGMENT_TOKENS = 1 << 20
FILE_TOKENS = 1 << 26
KEPT_CHUNKS = 3 << 18
SLICE_BYTES = 2 << 20
CODED_ROWS = 500

#: 0 blank, 1 letter, 2 digit, 3 sign, 4 anything that may change by what stands beside it.
KIND = np.full(256, 4, np.uint8)
KIND[0x21:0x7F] = 3
KIND[0x30:0x3A] = 2
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[[ord("'"), ord("<")]] = 4  # endings such as 's; special tokens
#: U+00C0 to U+00FF are xC3 and a second byte; all but two signs among them are letters.
LATIN = 0xC3
LATIN_SIGNS = (0x97, 0xB7)
#: The vocabulary's letter for each byte: printable ones stand for themselves, the others for U+0100 and on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
LETTERS = {b: chr(0x100 + n) for n, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}

#: Lengths of the four codes of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1


# --- texts to ids ------------------------------------------------------------------------
def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with plain words in lower case, starts and ends of the chunks, which are plain, and the rows' chunk offsets."""
    kind = KIND[data]
    latin = np.flatnonzero(data == LATIN)
    second = data[latin + 1]
    ok = ~np.isin(second, LATIN_SIGNS)
    latin, second = latin[ok], second[ok]
    kind[latin] = kind[latin + 1] = 1
    starts, ends, rows = spans(kind == 0, offsets)
    if not len(starts):
        return data, starts, ends, np.zeros(0, bool), rows
    odd = np.flatnonzero(kind == 4)
    plain = np.ones(len(starts), bool)
    plain[np.searchsorted(starts, odd, side="right") - 1] = False
    # a mark for each byte: does its word stay whole
    whole = np.zeros(len(data) + 1, np.int8)
    whole[starts[~plain]] += 1
    whole[ends[~plain]] -= 1
    whole = np.cumsum(whole[:-1], dtype=np.int8).astype(bool)
    data = data.copy()
    data[(data >= 0x41) & (data <= 0x5A) & ~whole] += 32
    data[latin[(second <= 0x9E) & ~whole[latin]] + 1] += 32
    cut = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    cut &= (kind[1:] > 0) & (kind[:-1] > 0) & ~whole[1:] & ~whole[:-1]
    edges = offsets[1:-1]
    cut[edges[(edges > 0) & (edges < len(data))] - 1] = False  # a word begins there already
    cut = np.flatnonzero(cut) + 1
    plain = np.concatenate([plain, np.ones(len(cut), bool)])
    starts = np.concatenate([starts, cut])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.sort(np.concatenate([ends, cut]))
    return data, starts, ends, plain[order], np.searchsorted(starts, offsets)


class Encoder:
    """Ids of whole texts, with the end id behind each."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.end_id = end_id
        self.kind = "<u2" if max(self.library.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.sizes, self.starts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _word(self, chunk: str) -> list[int]:
        """Ids of a plain chunk: one word of the model, its bytes in the vocabulary's letters."""
        shown = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(LETTERS)
        return [t.id for t in self.library.model.tokenize(shown)]

    def _learn(self, words: list[str], plain: list[bool]) -> None:
        new = [(w, p) for w, p in zip(words, plain, strict=True) if w not in self.number]
        if not new:
            return
        if len(self.number) + len(new) > KEPT_CHUNKS:
            self._clear()
            new = list(zip(words, plain, strict=True))
        others = iter(self.library.encode_batch([w for w, p in new if not p], add_special_tokens=False))
        found = [self._word(w) if p else next(others).ids for w, p in new]
        self.sizes = np.append(self.sizes, np.fromiter(map(len, found), np.int64, len(found)))
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(found), np.uint32)).astype(np.uint32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        for w, _ in new:
            self.number[w] = len(self.number)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, one after the other, and each row's number of ids."""
        data, offsets = text_bytes(texts)
        data, starts, ends, plain, rows = chunks(data, offsets)
        codes, words = distinct_words(data, starts, ends)
        words = words.to_numpy(zero_copy_only=False).tolist()
        is_plain = np.zeros(len(words), bool)
        is_plain[codes] = plain  # the characters of a chunk say whether it is plain
        self._learn(words, is_plain.tolist())
        n = len(texts)
        out_rows = np.zeros(n, np.int64)
        if not words:
            return np.full(n, self.end_id, np.uint32), out_rows + 1
        known = np.fromiter((self.number[w] for w in words), np.int64, len(words))[codes]
        size = self.sizes[known]
        before = np.zeros(len(known) + 1, np.int64)
        np.cumsum(size, out=before[1:])
        total = int(before[-1])
        ids = self.flat[np.arange(total) + np.repeat(self.starts[known] - before[:-1], size)]
        row_ends = before[rows[1:]]
        out_rows = row_ends - before[rows[:-1]] + 1
        out = np.insert(ids, row_ends, self.end_id).astype(np.uint32)
        theirs = self.library.encode(texts[0].as_py() or "", add_special_tokens=False).ids
        if theirs != out[: out_rows[0] - 1].tolist():
            raise RuntimeError("a text differs from the library's result")
        return out, out_rows


# --- codes -------------------------------------------------------------------------------
def encode_ranks(ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of documents of `sizes` ranks, and the documents' sizes in both."""
    ranks = np.ascontiguousarray(ranks, np.dtype("<u4"))
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    controls = -(-sizes // 4)
    first = np.cumsum(sizes) - sizes
    padded = np.zeros((int(controls.sum()), 4), np.uint8)
    shift = np.repeat(4 * (np.cumsum(controls) - controls) - first, sizes)
    padded.reshape(-1)[np.arange(len(ranks)) + shift] = code
    control = padded[:, 0] | padded[:, 1] << 2 | padded[:, 2] << 4 | padded[:, 3] << 6
    bytes_before = np.zeros(len(ranks) + 1, np.int64)
    np.cumsum(code, out=bytes_before[1:], dtype=np.int64)
    bytes_before += np.arange(len(ranks) + 1)
    return control, data, controls, bytes_before[first + sizes] - bytes_before[first]


def decode_ranks(control: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranks of documents of `sizes` ranks."""
    controls = -(-sizes // 4)
    first = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    at = np.arange(total) + np.repeat(4 * (np.cumsum(controls) - controls) - first, sizes)
    length = LENGTHS[control].reshape(-1)[at]
    ends = np.cumsum(length)
    if total and ends[-1] != len(data):
        raise ValueError("control bytes and data bytes disagree")
    begins = ends - length
    ranks = np.zeros(total, np.uint32)
    for k in range(4):
        has = length > k
        ranks[has] |= data[begins[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def segment_bytes(ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, control: bytes, data: bytes) -> bytes:
    body = known.astype(np.uint8).tobytes() + ids.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + control + data
    return struct.pack(HEADER, MAGIC, len(ids), int(sizes.sum()), len(control), len(data), zlib.crc32(body)) + body


def parse_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, whether they are known, sizes, and all ranks."""
    magic, n, tokens, n_control, n_data, crc = struct.unpack_from(HEADER, raw)
    body = memoryview(raw)[struct.calcsize(HEADER) :]
    if magic != MAGIC or len(body) != 13 * n + n_control + n_data or zlib.crc32(body) != crc:
        raise ValueError("broken segment")
    known = np.frombuffer(body, np.uint8, n)
    ids = np.frombuffer(body, "<i8", n, n)
    sizes = np.frombuffer(body, "<u4", n, 9 * n).astype(np.int64)
    if sizes.sum() != tokens:
        raise ValueError("broken segment")
    ranks = decode_ranks(np.frombuffer(body, np.uint8, n_control, 13 * n), np.frombuffer(body, np.uint8, n_data, 13 * n + n_control), sizes)
    return ids, known.astype(bool), sizes, ranks


# --- Spark -------------------------------------------------------------------------------
def encoder_of(path: str, end_id: int) -> Encoder:
    """The worker's encoder for a vocabulary file, with what it has learned in earlier tasks."""
    with open(path, "rb") as file:
        key = ("encoder", zlib.crc32(file.read()), end_id)
    cache = worker_cache()
    if key not in cache:
        cache[key] = Encoder(path, end_id)
    return cache[key]


def encoded(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tokens, ids (little-endian uint32, or uint16 where the vocabulary allows): every text, with the end id."""
    docs.sparkSession.sparkContext.addFile(vocabulary)  # executors need not hold the vocabulary file
    name = vocabulary.rsplit("/", 1)[-1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            for rows in text_slices(batch, "text", most=SLICE_BYTES):
                encoder = encoder or encoder_of(SparkFiles.get(name), end_id)
                ids, sizes = encoder.encode(rows.column("text"))
                ids = ids.astype(encoder.kind)
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(sizes), binaries(ids, sizes * ids.itemsize)], names=["id", "tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return in_arrow(rows, encode, "id long, tokens long, ids binary")


def binaries(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of `sizes` bytes each."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes))), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())


def ids_of(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of encoded rows, one after the other, and each row's number."""
    sizes = rows.column("tokens").to_numpy()
    column = rows.column("ids").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return raw.view("<u2" if 2 * sizes.sum() == len(raw) else "<u4"), sizes


def id_counts(tokens: DataFrame) -> DataFrame:
    """id, n: how often each id comes up in encoded texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                more = np.bincount(ids_of(batch)[0], minlength=len(total))
                more[: len(total)] += total
                total = more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return in_arrow(tokens.select("tokens", "ids"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def range_edges(rows: DataFrame, parts: int) -> np.ndarray:
    """Quantiles of the ids: range k holds the ids above edge k - 1, up to edge k."""
    shares = [k / parts for k in range(1, parts)]
    found = rows.agg(F.percentile_approx("id", shares, 20 * parts).alias("b")).first()["b"] if shares else None
    return np.asarray(found or [], np.int64)


def coded(tokens: DataFrame, rank_of: np.ndarray, edges: np.ndarray) -> DataFrame:
    """part, id, tokens, control, data: every encoded text in codes, and its range of ids.

    An id that is the edge of several ranges may stand in any of them, and its rows take turns.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for at in range(0, batch.num_rows, CODED_ROWS):
                rows = batch.slice(at, CODED_ROWS)
                ids, sizes = ids_of(rows)
                control, data, n_control, n_data = encode_ranks(rank_of[ids], sizes)
                id_ = rows.column("id")
                value = id_.fill_null(0).to_numpy(zero_copy_only=False)
                low = np.searchsorted(edges, value, side="left")
                wide = np.maximum(np.searchsorted(edges, value, side="right") - low, 1)
                part = low + (turn + np.arange(len(value))) % wide
                part[np.asarray(id_.is_null())] = 0
                turn += len(value)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), id_, rows.column("tokens"), binaries(control, n_control), binaries(data, n_data)], names=["part", "id", "tokens", "control", "data"])

    return in_arrow(tokens, code, "part int, id long, tokens long, control binary, data binary")


def write_files(rows: DataFrame, folder: str, parts: int, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Write each part as a file in order of the ids; a DataFrame of the segments that writes them when it is run."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        held: list[tuple] = []
        part, out, file, at, tokens, done = None, None, "", 0, 0, []

        def flush() -> None:
            nonlocal held, at, tokens
            if held:
                ids, sizes, control, data = zip(*held, strict=True)
                raw = segment_bytes(np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids]), np.array(sizes, np.int64), b"".join(control), b"".join(data))
                out.write(raw)
                done.append((part, f"{folder}/{file}.ids", at, len(raw), len(held), tokens))
                held, at, tokens = [], at + len(raw), 0

        def close() -> None:
            if out is not None:
                flush()
                out.close()
                system.move(f"{root}/.{file}", f"{root}/{file}.ids")

        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    close()
                    part, file, at = p, uuid.uuid4().hex, 0
                    out = system.open_output_stream(f"{root}/.{file}")
                held.append(tuple(row))
                tokens += row[1]
                if tokens >= segment_tokens:
                    flush()
        close()
        kinds = {"part": pa.int32(), "file": pa.string(), "at": pa.int64(), "bytes": pa.int64(), "documents": pa.int64(), "tokens": pa.int64()}
        yield pa.RecordBatch.from_pydict({k: pa.array([d[i] for d in done], t) for i, (k, t) in enumerate(kinds.items())})

    ordered = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "id", "tokens")
    return in_arrow(ordered, write, "part int, file string, at long, bytes long, documents long, tokens long")


def with_starts(segments: DataFrame) -> DataFrame:
    """The segments with `start`, the number of ids in all segments before them."""
    files = segments.groupBy("part").agg(F.sum("tokens").alias("file_tokens"))
    # one row a file meets in one task; a file's segments are added up in its own group
    files = files.select("part", (F.sum("file_tokens").over(Window.orderBy("part")) - F.col("file_tokens")).alias("base"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("at")) - F.col("tokens")
    return segments.withColumn("inside", inside).join(files, "part").withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside")


def read_files(segments: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """id, start, n_tokens, ids_crc32[, ids]: every document of the segments (with `start`), read from the files."""
    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = None
        for batch in batches:
            for uri, at, size, start in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "bytes", "start")), strict=True):
                if id_of is None:
                    system, root = opened(folder)
                    with system.open_input_file(f"{root}/{RANKS}") as file:
                        id_of = np.frombuffer(file.read(), "<u4")
                system, path = opened(uri)
                with system.open_input_file(path) as file:
                    ids, known, sizes, ranks = parse_segment(file.read_at(size, at))
                tokens = np.ascontiguousarray(id_of[ranks], "<u4")
                ends = np.cumsum(sizes)
                raw = memoryview(tokens).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(ids, pa.int64(), mask=~known), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(tokens.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_arrow(segments.repartition(tasks, "file", "at"), read, schema)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Write all texts to files in the shared folder and read every document back: id, start, n_tokens, ids_crc32[, ids]."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    tokens = scratch.table(encoded(docs, vocabulary, end_id, id_col, text_col), "tokens", compression="zstd")
    found = id_counts(tokens).collect()  # a row per id of the vocabulary at most
    n = np.zeros(max((r["id"] + 1 for r in found), default=1), np.int64)
    for r in found:
        n[r["id"]] = r["n"]
    id_of = np.argsort(-n, kind="stable").astype("<u4")
    rank_of = np.empty(len(n), np.uint32)
    rank_of[id_of] = np.arange(len(n), dtype=np.uint32)
    folder = scratch.path("files")
    system, root = opened(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{RANKS}") as out:
        out.write(id_of.tobytes())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n.sum()) // file_tokens))
    segments = scratch.table(write_files(coded(tokens, rank_of, range_edges(tokens, parts)), folder, parts, segment_tokens), "segments")
    scratch.drop(tokens)
    return read_files(with_starts(segments), folder, with_ids).withColumnRenamed("id", id_col)
