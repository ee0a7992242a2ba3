"""Shared helpers: tables in the cluster's shared folder, and word hashing over Arrow text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc  # a fresh Python worker has only what is imported here
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens.session import SHUFFLES_GO

MASK = (1 << 64) - 1


# --- tables in the shared folder ---------------------------------------------------------
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.  Only a local session without one gets a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="newslens-llm-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of a few MB while a table is written, for the memory of tasks with long texts; its shuffle files go when it is."""
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)} | SHUFFLES_GO
    before = {k: spark.conf.get(k) for k in most}
    for k, v in most.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v.removesuffix("b"))


def in_arrow(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """`mapInArrow` whose tasks give memory back when they end, as Python workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            if len(worker_cache().get("powers", ((),))[0]) > 1 << 20:
                del worker_cache()["powers"]
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(run, schema)


_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """The scratch tables that operators make inside the block are deleted at its end.

    Results read them, so write what is wanted before the block ends.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for root in _SCOPES.pop():
            _delete(spark, root)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Tables that cut the lineage: Parquet in the shared folder, so a lost executor costs only its running tasks.

    They stay until `drop`, or the end of an enclosing `temporary` block.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        if _SCOPES:
            _SCOPES[-1].append(self.root)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:02d}-{name}"

    def table(self, df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
        path = self.path(name)
        with _small_batches(self.spark):
            df.write.parquet(path, compression=compression)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later result reads."""
        for t in tables:
            _delete(self.spark, t._scratch_path)


def worker_cache() -> dict:
    """What a Python worker keeps from task to task.  Task functions come by value, with globals of their own each time, so it hangs on `sys`."""
    return sys.__dict__.setdefault("_newslens_worker_cache", {})


def small(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """A broadcast hint for a table of counted rows, up to `most`; beyond it Spark shuffles.  The rows must be narrow."""
    return F.broadcast(df) if rows <= most else df


def light(df: DataFrame, *lists: str, most: int = 64 << 20) -> DataFrame:
    """A broadcast hint for a written table whose rows and entries of `lists` (narrow ones) sum to `most` bytes at most."""
    entries = sum((F.coalesce(F.size(c), F.lit(0)) for c in lists), F.lit(0))
    rows, held = df.agg(F.count("*"), F.coalesce(F.sum(entries), F.lit(0))).first()
    return F.broadcast(df) if 64 * rows + 48 * held <= most else df


# --- Arrow text -------------------------------------------------------------------------
def text_slices(batch: pa.RecordBatch, *columns: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about `most` bytes of text in these columns, and one row at least."""
    sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) for c in columns)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


# --- hashing ----------------------------------------------------------------------------
def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply, xor-shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rule(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit constants, from a rule."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


BASE = 0x5851F42D4C957F2D
BYTE_CODE = rule(256, 11)
STEP = rule(64, 23)  # one multiplier for each place of a shingle
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** j and its inverse modulo 2 ** 64 for j < n, kept between calls (not in a global, which would go with every task function)."""
    kept = worker_cache().get("powers")
    if kept is None or len(kept[0]) < n:
        size = max(n, 1 << 20)
        made = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        kept = worker_cache()["powers"] = (made[0], made[1])
    return kept


def spans(separator: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of non-separator bytes: start and end of each, and the n + 1 offsets of the rows' runs."""
    n = len(separator)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator
    before = np.empty(n, bool)
    before[0], before[1:] = True, separator[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, separator[1:]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = True
    after[edges[edges > 0] - 1] = True
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each byte run [start, end) among the distinct ones, and those, as text.  The runs must not overlap."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] += 1
    edges[ends] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside])))
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """A 64-bit hash of each byte run [start, end); bytes whose code is 0 don't count."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    value = code[data] * up[: len(data)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without x20 and x09-x0D) of each row, A-Z lower-cased, and the rows' word offsets."""
    data, offsets = text_bytes(column)
    if fold:
        data = FOLD[data]
    starts, ends, rows = spans(SPACES[data], offsets)
    return run_hashes(data, starts, ends), rows


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words; a shorter sequence counts as one shingle; none without words."""
    if not len(words):
        return words
    if len(words) < size:
        return mix((words * STEP[: len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))
    out = words[: len(words) - size + 1] * STEP[0]
    for j in range(1, size):
        out = out + words[j : len(words) - size + 1 + j] * STEP[j]
    return mix(out + np.uint64(size))


def doc_shingles(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    words, rows = word_hashes(column)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        yield np.unique(shingle_hashes(words[a:b], size))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
