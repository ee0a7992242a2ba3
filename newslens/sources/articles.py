"""Article sources (S1-S3, S5, S13) and the article view of the test tables.

The analysis operators all read one canonical frame:

    doc_id BIGINT      ingest order (larger = later)
    url, title, section, source STRING
    pub_ts TIMESTAMP_NTZ (null when the time text was missing or bad)
    depth INT
    text STRING        paragraphs joined without separator (P1)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens import schema as S
from newslens.functions import exprs as X
from newslens.session import reuse, spread_texts, table_path

CORRUPT = "_corrupt_record"


# S1 -------------------------------------------------------------------------
def read_concat_json(spark: SparkSession, path: str, schema=S.ARTICLE_SCHEMA,
                     keep_order: bool = True, keep_rejects: bool = False,
                     quoted: bool = False) -> DataFrame:
    """Read objects glued together as `{...}{...}`; unparsable pieces are dropped.

    Splitting is done by the text source itself (`lineSep="}{"`), so large
    files are read in parallel splits; `parse_pieces` restores and parses them.
    With `keep_order` an `ingest_pos` column numbers the records in file order
    (see `with_file_order`).  By default every `}{` cuts, also inside a string
    (Q6); with `quoted` only those outside of strings do (`join_quoted`).
    """
    raw = spark.read.option("lineSep", "}{").option("wholetext", False).text(path)
    if quoted:
        raw = join_quoted(with_file_order(raw, keep_split=True))
    elif keep_order:
        raw = with_file_order(raw)
    return parse_pieces(raw, schema, keep=("ingest_pos",) if keep_order else (), keep_rejects=keep_rejects)


def join_quoted(pieces: DataFrame, cut: str = "}{") -> DataFrame:
    """Pieces (`value`, `ingest_pos`, `_split`) of files cut at every `}{` (or another `cut`) → (value, ingest_pos) of the
    records, cut only where it stands outside of a string.

    The automaton has two states, inside and outside of a string: a quote flips
    it, a backslash takes the next character with it, and a raw line break,
    which no JSON string holds, leads outside, so a torn string ends there.
    Pieces therefore map states to states in two ways only, flip by a parity or
    (with a line break) end in a fixed state, and parities add up.  They are
    composed inside each split, then over the one row a split leaves, and the
    state carried into a split is added to its pieces.  All this runs on narrow
    rows; texts are joined and grouped only for records of several pieces, so
    those of one piece are never shuffled.
    """
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    last_line = F.substring_index(bare, "\n", -1)
    flips = F.length(last_line) - F.length(F.replace(last_line, F.lit('"')))
    file = F.shiftright("ingest_pos", 40)
    split, here = ["_f", "_s"], Window.partitionBy("_f", "_s").orderBy("ingest_pos")
    narrow = pieces.select("ingest_pos", file.alias("_f"), F.col("_split").alias("_s"), (flips % 2).alias("_flip"),
                           bare.contains("\n").cast("int").alias("_fixed"))
    narrow = narrow.withColumn("_run", F.sum("_fixed").over(here))
    narrow = narrow.withColumn("_odd", F.sum("_flip").over(Window.partitionBy("_f", "_s", "_run").orderBy("ingest_pos")) % 2)
    # over the splits: one row each
    over = Window.partitionBy("_f").orderBy("_s")
    splits = narrow.groupBy(*split).agg(F.max_by("_odd", "ingest_pos").alias("_out"), (F.max("_run") > 0).cast("int").alias("_fixed"))
    splits = splits.withColumn("_run", F.sum("_fixed").over(over))
    splits = splits.withColumn("_after", F.sum("_out").over(Window.partitionBy("_f", "_run").orderBy("_s")) % 2)
    splits = splits.select(*split, F.lag("_after", 1, 0).over(over).alias("_carried"))
    known = narrow.join(splits, split)
    known = known.withColumn("_open", (F.col("_odd") + F.when(F.col("_run") == 0, F.col("_carried")).otherwise(0)) % 2)
    known = known.withColumn("_goes_on", F.coalesce(F.lag("_open").over(here), "_carried") == 1)
    known = known.withColumn("_first", F.max(F.when(~F.col("_goes_on"), F.col("ingest_pos"))).over(here))
    # a record that began in an earlier split: the last beginning before this one
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    begun = known.groupBy(*split).agg(F.max("_first").alias("_last")).select(*split, F.max("_last").over(before).alias("_begun"))
    several = known.where(F.col("_goes_on") | (F.col("_open") == 1)).join(begun, split)
    several = reuse(several.select("ingest_pos", F.coalesce("_first", "_begun").alias("_record")))
    single = pieces.join(several, "ingest_pos", "left_anti").select("value", "ingest_pos")
    parts = pieces.join(several, "ingest_pos").groupBy("_record").agg(F.array_sort(F.collect_list(F.struct("ingest_pos", "value"))).alias("_p"))
    return single.unionByName(parts.select(F.array_join(F.transform("_p", lambda x: x["value"]), cut).alias("value"), F.col("_record").alias("ingest_pos")))


def parse_pieces(pieces: DataFrame, schema=S.ARTICLE_SCHEMA, keep: tuple[str, ...] = (),
                 keep_rejects: bool = False) -> DataFrame:
    """Pieces (`value`) of a file cut at `}{` → records with an explicit schema (no inference).

    A piece lacks its first brace unless it opens the file, and its last one
    unless it closes it.  Only the missing ones are added: a piece that ends in
    the brace of a nested object gets its own back.  Pieces that don't parse are
    dropped, or kept with their text in `rejected` (null for records) so that
    they can be counted and looked at.
    """
    fields = [f for f in schema.fieldNames() if f != CORRUPT]
    full_schema = T.StructType([schema[f] for f in fields] + [T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    piece = F.regexp_replace("value", r"^\s+|\s+$", "")
    opened = F.when(piece.startswith("{"), piece).otherwise(F.concat(F.lit("{"), piece))
    out = pieces.where(F.length(piece) > 0) \
                .withColumn("_closed", F.from_json(F.concat(opened, F.lit("}")), full_schema, options)) \
                .withColumn("_last", F.from_json(opened, full_schema, options))
    rec = F.when(F.col(f"_closed.{CORRUPT}").isNull(), F.col("_closed")).otherwise(F.col("_last"))
    out = out.withColumn("_rec", rec)
    good = F.col(f"_rec.{CORRUPT}").isNull()
    cols = [F.when(good, F.col(f"_rec.{f}")).alias(f) for f in fields] + [F.col(c) for c in keep]
    if keep_rejects:
        return out.select(*cols, F.when(~good, F.col("value")).alias("rejected"))
    return out.where(good).select(*cols)


def with_file_order(df: DataFrame, keep_split: bool = False) -> DataFrame:
    """Number rows of a file scan in (file, offset) order without a global sort.

    Rows of one file split stay together in one partition and keep their order,
    so (file, split start, monotonically_increasing_id) orders them.  A small
    per-split table (one row per split) gets running offsets within its file
    (a window partitioned by file); files are numbered over the distinct file
    paths (one row per file, the only unpartitioned step).  Every row then gets
    `file_number << 40 | offset_in_file + position_in_split`: unique, ordered,
    and dense within the first file.  The rows themselves never meet in one task.
    `keep_split` keeps the offset at which a row's split begins as `_split`.
    """
    keyed = (df.withColumn("_f", F.col("_metadata.file_path"))
               .withColumn("_b", F.col("_metadata.file_block_start"))
               .withColumn("_m", F.monotonically_increasing_id()))
    splits = keyed.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    files = splits.select("_f").distinct() \
                  .withColumn("_fi", F.row_number().over(Window.orderBy("_f")) - 1)
    splits = splits.join(files, "_f")
    pos = F.shiftleft(F.col("_fi").cast("bigint"), 40) + F.col("_off") + F.col("_m") - F.col("_m0")
    return (keyed.join(splits.select("_f", "_b", "_m0", "_off", "_fi"), ["_f", "_b"])
                 .withColumn("ingest_pos", pos)
                 .withColumnRenamed("_b", "_split")
                 .drop("_f", "_m", "_m0", "_off", "_fi", *([] if keep_split else ["_split"])))


def articles_from_records(records: DataFrame, order_col: str = "ingest_pos") -> DataFrame:
    """S2 records → canonical article frame (P1, P2, P3, P13; Q7, Q10 mended).

    Records without paragraphs or with empty text are dropped; a missing or
    bad time gives a null `pub_ts` (kept for keywords and source counts).
    """
    text = X.content_text("content")
    return (records
            .where(F.col("content").isNotNull())
            .select(F.col(order_col).cast("bigint").alias("doc_id"),
                    F.col("url"),
                    X.with_default("title").alias("title"),
                    F.col("section"),
                    F.col("source"),
                    X.parse_pub_time(X.clean_time("time")).alias("pub_ts"),
                    F.col("depth").cast("int").alias("depth"),
                    text.alias("text"))
            .where(F.length("text") > 0))


# The test tables as articles ------------------------------------
NO_TIME_EVERY = 97  # every so many articles have no publish time in the view


def article_columns(d: DataFrame, e: DataFrame) -> list[Column]:
    return [
        d.doc_id,
        F.lit(None).cast("string").alias("url"),
        F.substring_index(d.text, "\n", 1).alias("title"),
        F.when(d.lang == "en", F.lit(S.NEWS_SECTION)).otherwise(d.lang).alias("section"),
        F.nullif(d.source, F.lit("src0")).alias("source"),
        F.when(d.doc_id % NO_TIME_EVERY != 0, e.ts.cast("timestamp_ntz")).alias("pub_ts"),
        (F.lit(1) + d.doc_id % 3).cast("int").alias("depth"),
        d.text,
    ]


def articles_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` with a publish time from `events` where the ids meet: the title is
    the whole first line; an article without an event has no publish time."""
    d = spark.read.parquet(table_path(sf_dir, "documents")).select(
        "doc_id", "text", "lang", "source")
    d = spread_texts(non_empty(d), "doc_id")
    e = spark.read.parquet(table_path(sf_dir, "events")).select("event_id", "ts")
    return d.join(e, d.doc_id == e.event_id, "left").select(*article_columns(d, e))


# S3 / S5 / S13 --------------------------------------------------------------
def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """One stop word per line, stripped, UTF-8; blank lines ignored."""
    return stopwords_of_lines(spark.read.text(path))


def stopwords_of_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """S3 over lines already read: (term), stripped, distinct, blank lines ignored."""
    return lines.select(X.py_strip(col).alias("term")).where(F.length("term") > 0).distinct()


def non_empty(articles: DataFrame, col: str = "text") -> DataFrame:
    """Rows whose text is there and not empty."""
    return articles.where(F.length(col) > 0)


def read_text(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """Batch read of text files (`value` per line); `suffix` keeps e.g. only `*.txt`."""
    reader = spark.read
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.text(path)
