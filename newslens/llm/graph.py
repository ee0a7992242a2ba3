"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node of its component) for every node of the edges (a, b long).

    In each round every root takes the least of its neighbours and itself in hash order,
    pointers are jumped once, and the edges are contracted to the new roots; edges inside
    a root vanish.  The hash order makes long falling chains unlikely, so the number of
    rounds grows with the logarithm of the longest path.  Each round's tables are written
    to the shared folder.
    """
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    left = scratch.table(both, "edges")
    labels: DataFrame | None = None
    while not left.isEmpty():
        hook = scratch.table(left.groupBy("a").agg(F.min(key("b")).alias("m")).select("a", F.least("m", key("a"))["v"].alias("p")), "hook")
        # jump: the parent's parent
        parent = hook.join(hook.select(F.col("a").alias("p"), F.col("p").alias("pp")), "p").select("a", F.col("pp").alias("p"))
        parent = scratch.table(parent, "parent")
        if labels is None:
            now = parent.select(F.col("a").alias("node"), F.col("p").alias("label"))
        else:
            now = labels.join(parent.select(F.col("a").alias("label"), "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
        now = scratch.table(now, "labels")
        ends = left.join(parent, "a").select(F.col("p").alias("a"), "b")
        ends = ends.join(parent.select(F.col("a").alias("b"), "p"), "b").select("a", F.col("p").alias("b")).where("a <> b").distinct()
        ends = scratch.table(ends, "edges")
        scratch.drop(left, hook, parent, *([labels] if labels is not None else []))
        left, labels = ends, now
    if labels is None:
        return both.select(F.col("a").alias("node"), F.col("a").alias("component"))
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return scratch.table(labels.join(least, "label").select("node", "component"), "components")
