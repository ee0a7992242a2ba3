"""Comparison of what is left over in long candidate lists, in blocks."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.llm.common import Scratch, small
from newslens.llm.graph import components

BLOCK_BYTES = 1 << 19
LIST_ROWS = 4096


def sliced(keys: DataFrame, scratch: Scratch, most: int = LIST_ROWS) -> DataFrame:
    """The rows of candidate lists (key, node) with `slice`: lists of more than `most` rows are cut by the node's hash.

    A long list's rows are so spread over tasks; pairs across slices are left to `rest_links`, which takes all of longer lists.
    """
    long = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).cast("int").alias("slices"))
    long = scratch.table(long, "long")
    n = long.count()
    if not n:
        return keys.withColumn("slice", F.lit(0))
    cut = keys.join(small(long, n), "key", "left")
    return cut.withColumn("slice", F.pmod(F.xxhash64("node", F.lit(5)), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")


def rest_links(rest: DataFrame, found: DataFrame, sets: DataFrame, similarity: Fraction, scratch: Scratch) -> DataFrame:
    """Links (a, b) between components, of the classes in longer lists (key, node).

    found: node, component (classes without a link may be missing); sets: node,
    values (sorted 64-bit hashes as bytes).  Classes that lists connect form a group.  Those outside a group's largest
    component are compared with the whole group: blocks of them meet blocks of the
    group, of about `BLOCK_BYTES` of values each, and a task counts common shingles through the block's postings.  It gives
    one link for each class and component reached, so what comes out grows with the
    classes and not with their pairs.
    """
    up, down = similarity.numerator, similarity.denominator
    head = rest.groupBy("key").agg(F.min("node").alias("b"))
    group = components(rest.join(head, "key").select(F.col("node").alias("a"), "b"), scratch).select("node", F.col("component").alias("group"))
    own = group.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = scratch.table(own, "groups")
    several = own.groupBy("group").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("group")
    told = scratch.table(own.join(several, "group").join(sets, "node").select("node", "group", "component", "values"), "told")
    sizes = told.groupBy("group", "component").agg(F.count("*").alias("n"), F.sum(F.octet_length("values")).alias("size")).groupBy("group")
    largest = F.struct("n", "component")
    sizes = sizes.agg(F.max_by("component", largest).alias("main"), F.max_by("size", largest).alias("main_size"), F.sum("size").alias("all"))
    blocks = lambda n: F.greatest(F.ceil(n / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")
    sizes = sizes.select("group", "main", blocks(F.col("all")).alias("wide"), blocks(F.col("all") - F.col("main_size")).alias("deep"))
    members = told.join(sizes, "group")
    part = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ("group", "i", "j")
    columns = (*keys, "node", "component", "values")
    named = lambda df: df.select(*(F.col(c).alias(c) for c in columns)).groupBy(*keys)
    minor = members.where("component <> main").withColumn("i", part(1, "deep")).withColumn("j", every("wide"))
    whole = members.withColumn("j", part(2, "wide")).withColumn("i", every("deep"))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            them = [np.frombuffer(v, np.uint64) for v in right.column("values").to_pylist()]
            size = np.array([len(v) for v in them])
            values, holder = np.concatenate(them), np.repeat(np.arange(len(them)), size)
            order = np.argsort(values, kind="stable")
            values, holder = values[order], holder[order]
            nodes, parts = right.column("node").to_numpy(), right.column("component").to_numpy()
            for node, component, v in zip(*(left.column(c).to_pylist() for c in ("node", "component", "values")), strict=True):
                own = np.frombuffer(v, np.uint64)
                lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                n = hi - lo
                at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                both = np.bincount(holder[at], minlength=len(them))
                hit = np.flatnonzero((both > 0) & (down * both >= up * (len(own) + size - both)) & (parts != component))
                _, first = np.unique(parts[hit], return_index=True)
                out += [(node, int(nodes[k])) for k in hit[first]]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return named(minor).cogroup(named(whole)).applyInArrow(meet, "a long, b long")
