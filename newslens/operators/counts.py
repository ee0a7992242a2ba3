"""Counting queries (A1-A5, P10 filter, P17/P18 chart fields).

All are grouped aggregates with map-side partial aggregation, so a key that
holds a third of all rows (one source, one hour, one word) is collapsed in
every map task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens import schema as S
from newslens.functions import exprs as X
from newslens.operators.ranking import top_k_per_group


# A1 ---------------------------------------------------------------------------
def words_of_lines(lines: DataFrame, col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per blank-separated word; empty strings from double blanks are words too."""
    return lines.select(*keep, F.explode(F.split(F.col(col), " ", -1)).alias("word"))


def word_count(lines: DataFrame, col: str = "value") -> DataFrame:
    """(word, n) over lines split on one blank (the empty word counts)."""
    return words_of_lines(lines, col).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def text_lines(df: DataFrame, col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Split stored texts into lines, as a text-file reader would (`value`)."""
    return df.select(*keep, F.explode(F.split(F.col(col), "\n", -1)).alias("value"))


# A2 ---------------------------------------------------------------------------
def countable(word: Column) -> Column:
    """Neither the empty word nor an integer literal (Q14 mended)."""
    return (F.length(word) > 0) & ~X.is_int_token(word)


def top_words(counts: DataFrame, k: int = S.HISTORY_TOP, group: str | None = None) -> DataFrame:
    """Top-k words by count (ties: word), integers and the empty word excluded.

    Without `group` it is a global top-k (TakeOrdered); with `group` a
    per-group top-k planned as partial + final WindowGroupLimit.
    """
    c = counts.where(countable(F.col("word")))
    order = [F.col("n").desc(), F.col("word").asc()]
    if group is None:
        top = c.orderBy(*order).limit(k)
        return top_k_per_group(top.withColumn("_g", F.lit(0)), "_g", order, k).drop("_g")
    return top_k_per_group(c, group, order, k)


# A3 ---------------------------------------------------------------------------
def count_by_source(articles: DataFrame) -> DataFrame:
    """(source, n); a missing source is its own bucket; ascending by count, then name."""
    src = F.coalesce(F.col("source"), F.lit(S.UNDEFINED_SOURCE))
    return (articles.groupBy(src.alias("source")).agg(F.count(F.lit(1)).alias("n"))
                    .orderBy(F.col("n").asc(), F.col("source").asc()))


# A4 ---------------------------------------------------------------------------
def hour_grid(articles: DataFrame, days: list[str] | None = None) -> DataFrame:
    """(day, hour, hour_label, n) zero-filled over days × 24 hours.

    `days` ('yyyy-MM-dd') defaults to every day that has an article.  The grid
    is built by exploding 24 hours per day (no cross join); counts come from one
    partial aggregate and are attached by an equi-join on (day, hour).
    """
    dated = articles.where(F.col("pub_ts").isNotNull())
    day = F.date_format("pub_ts", "yyyy-MM-dd")
    counts = dated.groupBy(day.alias("day"), X.hour_of("pub_ts").alias("hour")) \
                  .agg(F.count(F.lit(1)).alias("n"))
    if days is None:
        # Days with an article are exactly the days in the counts: reuse them.
        day_df = counts.select("day").distinct()
    else:
        day_df = articles.sparkSession.createDataFrame([(d,) for d in days], "day string")
    grid = day_df.select("day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return (grid.join(counts, ["day", "hour"], "left")
                .select("day", "hour", X.hour_label("hour").alias("hour_label"),
                        F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


# A5 ---------------------------------------------------------------------------
def distinct_urls(df: DataFrame, col: str = "url", approx: bool = False) -> DataFrame:
    """Number of distinct URLs; `approx` uses HyperLogLog++ for very large inputs."""
    agg = F.approx_count_distinct(col) if approx else F.countDistinct(col)
    return df.agg(agg.alias("n_urls"))


# A5, kept ----------------------------------------------------------------------
# Sketches of 2 ** SKETCH_LOG buckets: a relative standard error of about 1.04 / sqrt(2 ** SKETCH_LOG), 1.6 %.
SKETCH_LOG = 12


def url_sketches(urls: DataFrame, by: str, col: str = "url", log: int = SKETCH_LOG) -> DataFrame:
    """(by, sketch): one mergeable distinct-count sketch per group, of bounded size, combined in the map tasks."""
    return urls.groupBy(by).agg(F.hll_sketch_agg(col, log).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: str | None = None) -> DataFrame:
    """([by,] n_urls): the estimated number of distinct URLs over stored sketches, counted once however many groups hold them.

    A day's sketch is stored once; any set of days is counted from them without the URLs.
    """
    keys = [by] if by else []
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_urls"))
