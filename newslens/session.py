"""Session helpers.

The library never creates or stops a session on its own (operators take
DataFrames and return DataFrames); `build_session` is for tests, the bench and
command-line use only, and it never overrides a master chosen by spark-submit.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job of this package relies on: adaptive execution (runtime
# partition coalescing, skew-join splitting, broadcast decisions from measured
# sizes) and a fixed session time zone so timestamp maths match across engines.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "newslens", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with this package's defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None where the session has none (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions raise here
        return None


def checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the reliable checkpoint folder of this session.

    Order: the folder already set on the SparkContext, then the cluster's
    ``spark.checkpoint.dir``.  Only a local-mode session without either gets a
    private folder (tests, laptops); on a cluster we never invent a
    machine-local path and return None instead.
    """
    sc = _context(spark)
    if sc is None:  # e.g. a Spark Connect client: the server owns the folder
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="newslens-ckpt-"))
        return sc.getCheckpointDir()
    return None


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path for files that all executors share: below ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="newslens-work-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Shuffle files go when the write or micro-batch that made them ends, not when the driver collects its garbage.
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cores(spark: SparkSession) -> int:
    """Tasks that run at once, as far as the session knows."""
    sc = _context(spark)
    return sc.defaultParallelism if sc else int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_parallel(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has cores.

    A file written as one row group is read by one task, and every per-row
    step after it (tokenizing, regex extraction) would run single-threaded.
    The check is on the planned split count only: a large input already has
    enough splits and is left untouched (no extra shuffle at scale).
    """
    sc = _context(df.sparkSession)
    if sc is None:
        return df
    target = sc.defaultParallelism
    try:
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view: leave the plan as it is
        return df
    if splits >= target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)


# Bytes of text that one task cuts into words and counts: the words of a partition
# stand in one hash table, so this and not the input's size bounds it.
TEXT_BYTES = 16 << 20


def spread_texts(df: DataFrame, *keys: str, text_col: str = "text", text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Deal a scan of texts by `keys` over partitions of about `text_bytes`, at least one a core.

    Planned splits say nothing about the rows in them (a file of one row group has many
    splits, and all its rows in one of them), nor do stored bytes, as repeated texts are stored
    once: the texts' bytes are summed up when the plan is built.  The number of
    partitions is fixed, so adaptive execution does not put them together by their
    compressed size.  A join on the keys takes this dealing over.
    """
    sc = _context(df.sparkSession)
    if sc is None:
        return df
    total = df.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = -(-total // text_bytes)
    if parts > sc.defaultParallelism:
        parts = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = max(parts, sc.defaultParallelism)
    return df.repartition(parts, *keys) if keys else df.repartition(parts)


# Frames kept for the innermost `kept()` block; outside of one, by session.
_BLOCKS: list[list[DataFrame]] = []
_LOOSE: list[DataFrame] = []


def reuse(df: DataFrame) -> DataFrame:
    """Keep an intermediate that several branches of one plan read.

    Without it each branch recomputes the upstream (scan, tokenizer, first
    aggregate).  MEMORY_AND_DISK spills instead of failing; a block lost with
    its executor is recomputed from lineage.  Nothing runs here: the frame is
    kept when a result that needs it runs.
    """
    frame = df.persist(StorageLevel.MEMORY_AND_DISK)
    (_BLOCKS[-1] if _BLOCKS else _LOOSE).append(frame)
    return frame


@contextlib.contextmanager
def kept() -> Iterator[None]:
    """What `reuse` keeps inside the block is given back at its end, and nothing else is."""
    _BLOCKS.append([])
    try:
        yield
    finally:
        _drop(_BLOCKS.pop())


def release(spark: SparkSession | None = None) -> None:
    """Give back the frames kept outside of any block (of one session, or of all)."""
    own = [f for f in _LOOSE if spark is None or f.sparkSession is spark]
    _LOOSE[:] = [f for f in _LOOSE if not any(f is o for o in own)]
    _drop(own)


def _drop(frames: list[DataFrame]) -> None:
    for f in frames:
        with contextlib.suppress(Exception):  # the frame's session may have ended
            f.unpersist()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
