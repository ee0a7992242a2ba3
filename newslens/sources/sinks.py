"""Writers and legacy-format readers.

Every writer goes through Spark's file commit protocol (a failed or retried
job leaves no partial output visible); nothing is gathered on the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from newslens import schema as S
from newslens.functions import exprs as X
from newslens.operators import pages as PG
from newslens.operators import text as TX
from newslens.sources import articles as AR
from newslens.sources import seen as SEEN


# S6 ---------------------------------------------------------------------------
def write_report(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8 as is (no \\u escapes), replacing the previous report."""
    df.write.mode("overwrite").option("encoding", "UTF-8").json(path)


def window_keyword_report(block_kw: DataFrame, at: str) -> DataFrame:
    """One row {time, timekeyword[]} from the (≤ k rows) block keywords."""
    arr = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return block_kw.agg(F.transform(arr, lambda s: s["term"]).alias("timekeyword")) \
                   .select(F.lit(at).alias("time"), "timekeyword")


# S9 ---------------------------------------------------------------------------
def append_new_articles(new: DataFrame, store_path: str, order_col: str = "page_id",
                        batch_id: str | None = None, seen_path: str | None = None) -> DataFrame:
    """Append articles whose canonical URL no other batch has stored; one row per URL.

    The store is partitioned by `batch_id` (a new one where none is given).  A batch that is run again is compared
    with the other batches only and replaces its own partition, so the result
    does not depend on how often it ran.  Returns what the batch has stored, read
    back from its partition.

    The URLs seen are those of the article store, or, with `seen_path`, those of a bucketed
    store (`sources.seen`), of which only the batch's buckets are read; the articles are
    written before their URLs, so a batch that fails in between can be run again.
    """
    spark = new.sparkSession
    batch_id = batch_id or uuid.uuid4().hex
    fresh = PG.first_per_url(new, order_col)
    if seen_path is not None:
        fresh = SEEN.unseen_in_store(fresh, seen_path, batch_id)
    else:
        try:
            stored = spark.read.parquet(store_path).where(F.col("batch_id").cast("string") != F.lit(batch_id)).select("url")
            fresh = PG.unseen(fresh, stored)
        except AnalysisException as e:  # first write: the store does not exist yet
            if (e.getCondition() or "") != "PATH_NOT_FOUND" and "does not exist" not in str(e):
                raise
    own = f"{store_path}/batch_id={batch_id}"
    fresh.write.mode("overwrite").parquet(own)
    back = spark.read.schema(fresh.schema).parquet(own)
    if seen_path is not None:
        SEEN.mark_seen(back, seen_path, batch_id)
    return back


# S10 --------------------------------------------------------------------------
def token_lines(articles: DataFrame, stopwords=S.DEFAULT_STOPWORDS, ts_col: str = "pub_ts",
                mode: str = "words") -> DataFrame:
    """(doc_id, minute, value): one line of blank-separated, stop-filtered tokens per dated article."""
    sent = TX.token_sentence(articles.where(F.col(ts_col).isNotNull()), stopwords, mode, keep=(ts_col,))
    return sent.select("doc_id", F.date_format(ts_col, S.FILE_MINUTE_FORMAT).alias("minute"), F.col("sentence").alias("value"))


def write_token_files(articles: DataFrame, path: str, stopwords=S.DEFAULT_STOPWORDS,
                      ts_col: str = "pub_ts", mode: str = "words", batch_id: str = "0") -> None:
    """The token lines as text files, one folder per batch and minute.

    A batch that is run again replaces its folders; rows meet by minute before
    they are written, so a minute is few files.
    """
    (token_lines(articles, stopwords, ts_col, mode)
        .select(F.lit(batch_id).alias("batch_id"), "minute", "value")
        .repartition("minute")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id", "minute").text(path))


# S11 --------------------------------------------------------------------------
LEGACY_COUNT = r"""^\(\s*(['"])(.*)\1,\s*(-?[0-9]+)\)\s*$"""


def read_counts(spark: SparkSession, path: str, legacy: bool = False) -> DataFrame:
    """(word, n) of one batch; legacy text lines `('word', n)` are parsed, never evaluated.

    An empty batch gives an empty frame.
    """
    if not legacy:
        return spark.read.parquet(path).select("word", "n")
    return parse_counts(spark.read.text(path))


def parse_counts(lines: DataFrame) -> DataFrame:
    """S11 over lines already read (`value`); other lines are dropped."""
    lines = lines.where(F.col("value").rlike(LEGACY_COUNT))
    # one pass from the left: each backslash belongs to the character behind it
    word = F.regexp_replace(F.regexp_extract("value", LEGACY_COUNT, 2), r"""\\(['"\\])""", "$1")
    return lines.select(word.alias("word"),
                        F.regexp_extract("value", LEGACY_COUNT, 3).cast("bigint").alias("n"))


# S12 --------------------------------------------------------------------------
HISTORY_JSON = (f"map<string, array<struct<`{S.HISTORY_KEYWORD_FIELD}`: string, "
                f"`{S.HISTORY_COUNT_FIELD}`: bigint>>>")


FRAME_CUT = "],"  # between the frames of one object


def read_history(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """History JSON object(s) → (batch_minute, rank, keyword, n); each file is one object.

    Files are read in parallel.  An object of the original tool is one file's
    size; our own export (`export_history_json`) has one small object per frame.
    With `split` a file is cut between its frames by the text source, so one huge
    object is read by many tasks; cuts inside a string are joined again (`join_quoted`).
    """
    if not split:
        return parse_history(spark.read.text(path, wholetext=True))
    raw = AR.with_file_order(spark.read.option("lineSep", FRAME_CUT).text(path), keep_split=True)
    frame = X.py_strip("value")
    # the first frame has the object's brace before it, the last one both ends behind it
    entries = F.regexp_replace(F.regexp_replace(frame, r"^\{\s*", ""), r"\]\s*\}$", "")
    frames = AR.join_quoted(raw, FRAME_CUT).select("ingest_pos", entries.alias("e")).where(F.col("e").startswith('"'))
    return parse_history(frames.select(F.concat(F.lit("{"), F.col("e"), F.lit("]}")).alias("value")))


def parse_history(objects: DataFrame, key_col: str = "batch_minute") -> DataFrame:
    """S12 over JSON objects already read (`value`); `key_col` names the frame's key.

    Keys in either `HH:mm` or the older `HH-mm` form are read and normalised to
    the former; `rank` is the position within the frame as written.
    """
    frames = objects.select(F.explode(F.from_json("value", HISTORY_JSON)).alias("k", "entries"))
    key = F.regexp_replace("k", r"^(\d{4}-\d{2}-\d{2} \d{2})-(\d{2})$", "$1:$2")
    pos = frames.select(key.alias(key_col), F.posexplode("entries").alias("pos", "e"))
    return pos.select(key_col, (F.col("pos") + 1).cast("int").alias("rank"),
                      F.col(f"e.{S.HISTORY_KEYWORD_FIELD}").alias("keyword"),
                      F.col(f"e.{S.HISTORY_COUNT_FIELD}").alias("n"))


def history_frames(hist: DataFrame) -> DataFrame:
    """Each frame ascending by count (ties: keyword) → (key, pos, keyword, n).

    The key is `batch_time`, or `batch_minute` of a history in the original
    format.  Frames hold at most k rows each, so the window per frame is bounded.
    """
    key = "batch_time" if "batch_time" in hist.columns else "batch_minute"
    w = Window.partitionBy(key).orderBy(F.col("n").asc(), F.col("keyword").asc())
    return hist.select(key, F.row_number().over(w).alias("pos"), "keyword", "n")


def history_objects(hist: DataFrame) -> DataFrame:
    """(batch_time, value): each frame as the JSON object that `parse_history` reads."""
    entry = F.struct(F.col("rank"), F.col("keyword").alias(S.HISTORY_KEYWORD_FIELD),
                     F.col("n").alias(S.HISTORY_COUNT_FIELD))
    frames = hist.groupBy("batch_time").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    entries = F.transform("e", lambda s: s.dropFields("rank"))
    return frames.select("batch_time", F.to_json(F.create_map(F.col("batch_time"), entries)).alias("value"))


def export_history_json(hist: DataFrame, path: str) -> None:
    """One JSON object per line and frame: {"batch_time", "entries": [{keyword, count}, …]}."""
    entry = F.struct(F.col("rank"), F.col("keyword").alias(S.HISTORY_KEYWORD_FIELD),
                     F.col("n").alias(S.HISTORY_COUNT_FIELD))
    frames = hist.groupBy("batch_time").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    frames = frames.select("batch_time", F.transform("e", lambda s: s.dropFields("rank")).alias("entries"))
    write_report(frames, path)


# P16 convenience: the seen set of a store's raw text -------------------------
def seen_urls_from_text(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild the seen-URL set from a stored article file by pattern."""
    return spark.read.text(path).select(F.explode(X.urls_in_text("value")).alias("url")).distinct()
