"""Word counts of a text stream by the lines' own times, with late data (W1, W2, W4 by event time).

    readStream((time, value) lines) → watermark → words → tumbling windows
        → counts in Spark's state store → each window appended once, when it closes

`newslens.streaming.word_history` counts a line in the batch that picks it up; here the line's
time decides.  A window stays open until the watermark, the latest time seen less
`delay`, has passed its end; lines that arrive behind that are late and change nothing.
State and output follow the checkpoint, so a restart goes on where the last run ended,
and a batch that is run again appends nothing twice (the file sink's log).  Windows without words leave no row (W4).

Late lines are counted exactly, by accounting: beside its words each line adds one row
of the null word, so a window also counts its lines, and those that are neither
appended nor waiting in the state store came too late.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newslens import schema as S

DELAY = "10 minutes"
LINE_SCHEMA = "ts timestamp, value string"


def stream_lines(spark: SparkSession, path: str, schema: str = LINE_SCHEMA, fmt: str = "parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """New files of timed lines in a folder, oldest first."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def window_counts(lines: DataFrame, ts_col: str = "ts", interval: str = S.STREAM_INTERVAL, delay: str = DELAY) -> DataFrame:
    """(window, word, n) of timed lines; the null word counts the window's lines.

    The same plan over stored lines gives all windows at once.  Counting has a partial
    phase in the map tasks, so a window or word that most lines share is a few rows there.
    """
    words = F.concat(F.array(F.lit(None).cast("string")), F.split("value", " ", -1))
    rows = lines.withWatermark(ts_col, delay).where(F.col("value").isNotNull() & F.col(ts_col).isNotNull())
    return rows.select(F.col(ts_col), F.explode(words).alias("word")).groupBy(F.window(ts_col, interval).alias("window"), "word").agg(F.count(F.lit(1)).alias("n"))


def start_window_counts(lines: DataFrame, out: str, checkpoint: str, ts_col: str = "ts", interval: str = S.STREAM_INTERVAL,
                        delay: str = DELAY, available_now: bool = False) -> StreamingQuery:
    """Append each window's counts to the table `out` when it closes; `available_now` drains all that is there and stops."""
    counts = window_counts(lines, ts_col, interval, delay)
    rows = counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "word", "n")
    writer = rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", out)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def _appended(spark: SparkSession, out: str) -> DataFrame:
    schema = "window_start timestamp, window_end timestamp, word string, n long"
    try:
        spark.read.parquet(out)
    except AnalysisException as e:  # no window has closed yet
        if (e.getCondition() or "") not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out)


def read_window_counts(spark: SparkSession, out: str) -> DataFrame:
    """(window_start, window_end, word, n) of the closed windows."""
    return _appended(spark, out).where("word is not null")


def pending(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(window_start, window_end, word, n) of the windows still open, read from the state store."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("key.window.start").alias("window_start"), F.col("key.window.end").alias("window_end"), F.col("key.word").alias("word"), F.col("value.count").alias("n"))


def line_account(spark: SparkSession, read: DataFrame, out: str, checkpoint: str, ts_col: str = "ts") -> DataFrame:
    """One row (lines, counted, open, late): what became of the lines of `read`, all that the stream has taken in."""
    lines = read.where(F.col("value").isNotNull() & F.col(ts_col).isNotNull()).select(F.count(F.lit(1)).alias("lines"))
    total = lambda df: F.coalesce(df.where("word is null").select(F.sum("n")).scalar(), F.lit(0))
    return lines.select("lines", total(_appended(spark, out)).alias("counted"), total(pending(spark, checkpoint)).alias("open")) \
                .withColumn("late", F.col("lines") - F.col("counted") - F.col("open"))
