"""Sharding by a keyed permutation (operator 9).

Every row gets a global row number 0..n-1; a Feistel network with cycle walking
permutes the numbers; permuted number p goes to shard `p % shards`, slot
`p // shards`.  Shard sizes so differ by one row at most, slots have no gaps, and
place and row number can be computed from each other (`permute`, `restore`)
without a table.

The global order is that of a hash of (id, size, crc): hash buckets of about
`BUCKET_ROWS` rows (`BUCKETS` of them at least) are counted, numbered by a running sum
over those counts, and rows are ranked inside their bucket, so there are as many
rankings as the rows need.  Rows equal in all three fields are counted, not moved: a
row repeated any number of times is one counted row until its numbers are
dealt out, so no task holds a hot group.

Nulls: a null text has size 16 and crc 0; a null id is an id of its own.  Repeated
rows each get a place of their own.  An empty table gives no rows.  Other columns
of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslens.llm.common import Scratch, mix

BUCKETS = 4096
BUCKET_ROWS = 1 << 17
ROUNDS = 6
BLOCK = 1 << 16


def _network(x: np.ndarray, half: int, seed: int, back: bool) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    bits = np.uint64(half)
    left, right = x >> bits, x & low
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        salt = np.uint64((seed * ROUNDS + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        if back:
            left, right = right ^ (mix(left + salt) & low), left
        else:
            left, right = right, left ^ (mix(right + salt) & low)
    return left << bits | right


def _walk(numbers: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    out = _network(numbers.astype(np.uint64), half, seed, back)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _network(out[outside], half, seed, back)
    return out.astype(np.int64)


def permute(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The permuted place of each row number below n."""
    return _walk(np.asarray(numbers, np.int64), n, seed, False)


def restore(places: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The row number at each permuted place."""
    return _walk(np.asarray(places, np.int64), n, seed, True)


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, row_number, place, shard, slot."""
    scratch = Scratch(docs.sparkSession, "shard")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    buckets = max(BUCKETS, -(-docs.count() // BUCKET_ROWS))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).alias("crc"))
    rows = rows.withColumn("order", F.xxhash64("id", "size", "crc")).withColumn("bucket", F.pmod("order", F.lit(buckets)).cast("int"))
    counted = scratch.table(rows.groupBy("bucket", "order", "id", "size", "crc").agg(F.count("*").alias("copies")), "counted")
    # a row per bucket: one task holds them
    sums = counted.groupBy("bucket").agg(F.sum("copies").alias("rows")).select("bucket", (F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")).alias("base"))
    n = counted.agg(F.sum("copies")).first()[0] or 0
    inside = Window.partitionBy("bucket").orderBy("order", "id", "size", "crc")
    ranked = counted.withColumn("before", F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranked.join(F.broadcast(sums), "bucket").withColumn("first", F.col("base") + F.coalesce("before", F.lit(0)))
    # the numbers of a much repeated row are dealt out by blocks
    blocks = ranked.withColumn("block", F.explode(F.expr(f"sequence(0L, copies - 1, {BLOCK}L)")))
    numbered = blocks.withColumn("row_number", F.explode(F.expr(f"sequence(first + block, first + least(block + {BLOCK}, copies) - 1)")))

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    out = numbered.withColumn("place", place("row_number"))
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "row_number", "place",
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"),
    )
