"""Hotness, scaling and ordering.

Corpus-wide constants (min / max of the raw score) are scalar subqueries:
one small aggregate job whose single value is inlined into the projection —
no cross join and no unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslens import schema as S
from newslens.functions import exprs as X
from newslens.session import reuse


# R1 ---------------------------------------------------------------------------
def raw_hotness(votes: Column, age: Column, depth: Column, section: Column,
                g: float = S.GRAVITY) -> Column:
    """(votes − 1) / ((age + 2)·g) · (10 − depth)², tripled for the news section.

    Division by zero (age −2) yields null instead of failing (Q8).
    """
    base = F.try_divide((votes - F.lit(1)).cast("double"),
                        (age + F.lit(S.AGE_OFFSET)).cast("double") * F.lit(g))
    depth_gap = F.lit(S.DEPTH_CEILING) - depth
    score = base * (depth_gap * depth_gap)
    return F.when(section == F.lit(S.NEWS_SECTION), score * F.lit(S.NEWS_FACTOR)).otherwise(score)


# A6 / R2 ------------------------------------------------------------------------
def min_max_scale(df: DataFrame, col: str, out: str, top: float = 100.0) -> DataFrame:
    """Scale `col` to 0..top by the global min and max (equal values → 0.0).

    `df` is read twice (bounds, then every row): it is kept so the bounds
    subquery does not recompute its upstream plan.
    """
    df = reuse(df)
    bounds = df.select(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    scaled = F.try_divide(F.col(col) - bounds["lo"], bounds["hi"] - bounds["lo"]) * F.lit(top)
    return df.withColumn(out, F.coalesce(scaled, F.lit(0.0)))


def with_age(articles: DataFrame, now: str) -> DataFrame:
    """`age` in whole minutes relative to one fixed `now`."""
    return articles.withColumn("age", X.age_minutes("pub_ts", now))


def hotness(articles: DataFrame, votes_df: DataFrame, now: str = S.QUERY_NOW,
            g: float = S.GRAVITY) -> DataFrame:
    """(doc_id, title, votes, age, raw, hotness) for articles with a publish time."""
    dated = with_age(articles.where(F.col("pub_ts").isNotNull()), now)
    scored = (dated.join(votes_df, "doc_id", "left")
                   .withColumn("votes", F.coalesce("votes", F.lit(0)))
                   .withColumn("raw", raw_hotness(F.col("votes"), F.col("age"),
                                                  F.col("depth"), F.col("section"), g)))
    return min_max_scale(scored, "raw", "hotness").select(
        "doc_id", "title", "votes", "age", "raw", "hotness")


# R4 ---------------------------------------------------------------------------
def hot_board(hot: DataFrame, n: int | None = None) -> DataFrame:
    """Articles by hotness descending (ties: doc_id); `n` keeps the top n only."""
    order = [F.col("hotness").desc(), F.col("doc_id").asc()]
    if n is not None:
        return hot.orderBy(*order).limit(n)
    return hot.orderBy(*order)


# R6 ---------------------------------------------------------------------------
def top_k_per_group(df: DataFrame, group: str | list[str], order: list[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """row_number ≤ k per group; planned as partial + final WindowGroupLimit."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


# R7 ---------------------------------------------------------------------------
def last_n(articles: DataFrame, n: int = S.BLOCK_LAST_N) -> DataFrame:
    """The latest n articles by ingest order (TakeOrdered, not a global sort)."""
    return articles.orderBy(F.col("doc_id").desc()).limit(n)
