"""Word counts of a text stream and the word-count history.

    readStream(text) → foreachBatch: words of the batch → counts (S7)
        → top-k (W3) → upsert into the history keyed by the batch's time (S8)

Arrival decides the batch, as in the original: a file counts in the micro-batch
that picks it up, whatever its own time stamp, so no file can be late, no state
is held, and the last batch is written like every other.  The trigger interval
is the batch interval (W1: 61 s; W2: 20 s or 90 s).

A batch's time is recorded under its id the first time the id is seen; a batch
that is replayed after a failure finds it there, so it writes the same keys
again, and both sinks replace what they wrote before.  Batches without any word
leave no entry (W4).  The batch twin over stored lines with times of their own is
`newslens.plans.reports.word_history`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newslens import schema as S
from newslens.operators import counts as C

HISTORY_COLUMNS = ("batch_time", "rank", "keyword", "n")


# S4 ---------------------------------------------------------------------------
def stream_text(spark: SparkSession, path: str, suffix: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """New text files in a folder → (file, value)."""
    reader = spark.readStream.format("text").schema("value string")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path).select(F.col("_metadata.file_path").alias("file"), "value")


# W1 / W2 ------------------------------------------------------------------------
def batch_word_count(lines: DataFrame, batch_time: str) -> DataFrame:
    """(batch_time, word, n) of one micro-batch; not cumulative."""
    counts = C.word_count(lines)
    return counts.select(F.lit(batch_time).alias("batch_time"), "word", "n")


# W3 -----------------------------------------------------------------------------
def batch_history(counts: DataFrame, k: int = S.HISTORY_TOP) -> DataFrame:
    """Top-k countable words of each batch → (batch_time, rank, keyword, n)."""
    top = C.top_words(counts, k, group="batch_time")
    return top.select("batch_time", F.col("rank").cast("int").alias("rank"),
                      F.col("word").alias("keyword"), "n")


# S8 -----------------------------------------------------------------------------
def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if (e.getCondition() or "") in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA") or "does not exist" in str(e):
            return None
        raise


def upsert_history(history: DataFrame, path: str) -> None:
    """The entries of the given batch times are replaced, every other entry is kept.

    The store has one partition per day.  The days concerned are merged into a
    staging folder beside the store first and then replace their partitions, so
    nothing is read from what is being overwritten.
    """
    spark = history.sparkSession
    new = history.select(*HISTORY_COLUMNS, F.substring("batch_time", 1, 10).alias("day"))
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    new.write.parquet(f"{staging}/new")
    new = spark.read.schema(new.schema).parquet(f"{staging}/new")
    merged = new
    if (stored := _stored(spark, path)) is not None:
        stored = stored.withColumn("day", F.col("day").cast("string"))
        # days and times of one batch: a handful of rows, read back for partition pruning
        days = [r.day for r in new.select("day").distinct().collect()]
        times = new.select("batch_time").distinct()
        merged = merged.unionByName(stored.where(F.col("day").isin(days)).join(times, "batch_time", "left_anti").select(*new.columns))
    merged.write.parquet(f"{staging}/merged")
    (spark.read.schema(new.schema).parquet(f"{staging}/merged").repartition("day")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))
    folder = spark._jvm.org.apache.hadoop.fs.Path(staging)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def batch_time_of(spark: SparkSession, batch_id: int, path: str) -> str:
    """The time recorded for a batch id; recorded now if the id is new."""
    own = f"{path}/batch_id={batch_id}"
    if (stored := _stored(spark, own)) is not None and (row := stored.first()) is not None:
        return row.batch_time
    now = F.date_format(F.current_timestamp(), S.BATCH_KEY_FORMAT + ".SSS")  # batches follow each other, no two start in one millisecond
    spark.range(1).select(now.alias("batch_time")).write.mode("overwrite").parquet(own)
    return spark.read.parquet(own).first().batch_time


# S7 / S8 ------------------------------------------------------------------------
def history_sink(history_path: str, counts_path: str | None = None,
                 k: int = S.HISTORY_TOP) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: write the batch's counts (S7) and upsert its top-k."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = batch_time_of(spark, batch_id, f"{history_path}/_batches")
        counts = batch_word_count(batch, at).persist()
        try:
            if counts_path:
                counts.write.mode("overwrite").parquet(f"{counts_path}/batch_id={batch_id}")
            top = batch_history(counts, k)
            if not top.isEmpty():
                upsert_history(top, history_path)
        finally:
            counts.unpersist()
    return write


def start_word_history(spark: SparkSession, source_dir: str, history_path: str,
                       checkpoint: str, counts_path: str | None = None,
                       interval: str = S.STREAM_INTERVAL, available_now: bool = False,
                       suffix: str | None = ".txt", k: int = S.HISTORY_TOP,
                       max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Y6 stream: start the query; `available_now` drains all that is there and stops."""
    lines = stream_text(spark, source_dir, suffix, max_files_per_trigger)
    writer = (lines.writeStream.outputMode("append")
                   .option("checkpointLocation", checkpoint)
                   .foreachBatch(history_sink(history_path, counts_path, k)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def read_history_table(spark: SparkSession, path: str) -> DataFrame:
    """The history store as (batch_time, rank, keyword, n)."""
    return spark.read.parquet(path).select(*HISTORY_COLUMNS)
