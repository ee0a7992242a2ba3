"""Exact top-k inner-product search (operator 1).

Vectors are put into shards of bounded size by a hash of their id.  A task builds a
ball tree over its shard (median splits along the direction of the widest spread;
centre, radius and smallest id per node) and searches it branch-and-bound for a block
of queries: nodes are taken in order of their upper bound `q.c + |q| r`, and a node
whose bound can't beat the current k-th score is cut, as is one that could only tie
with a larger id.

The k-th score is shared between shards: queries first search one shard each, then
waves of further shards, each wave eight times as many as all before; the k-th score
so far travels with the query, so later shards are cut at their root or near it.
Rows of a wave are (shard, query block) groups, each of bounded size.

Vectors that are null, empty, or hold a null or non-finite component, and rows without
an id, take no part.  Rows that repeat an id count once, with the least of their
vectors.  Vectors of different lengths are not compared.  Ties go to the smaller id.
Scores are exact: components are whole numbers; where products could pass 2**53 they
are summed as Python integers, and scores beyond the long range are given as its ends.
Fewer than k candidates give fewer rows; an empty table gives none.  Other columns
are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.llm.common import Scratch

LEAF = 64
RESULT = "query_id long, vec_id long, score long"
LONG = np.iinfo(np.int64)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v, the whole-number components floor(scale * x), of every valid row."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (F.abs(c * scale) == float("inf")))
    valid = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad)
    # rint-free floor: whole doubles stay whole, and beyond the long range doubles are whole already
    floor = lambda c: F.when(F.abs(c * scale) < 2.0**53, F.floor(c * scale).cast("double")).otherwise(c * scale)
    rows = valid.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, floor).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


class BallTree:
    """Points in tree order; node i has children 2i+1 and 2i+2 and covers points[lo[i]:hi[i]]."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        n = len(ids)
        depth = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
        size = 2 ** (depth + 1) - 1
        self.first_leaf = 2**depth - 1
        self.lo, self.hi = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.centre, self.radius, self.least = np.zeros((size, points.shape[1])), np.zeros(size), np.full(size, LONG.max)
        order = np.argsort(ids, kind="stable")
        self.hi[0] = n
        for i in range(size):
            lo, hi = self.lo[i], self.hi[i]
            if lo == hi:
                continue
            own = points[order[lo:hi]]
            self.centre[i] = own.mean(axis=0)
            self.radius[i] = np.sqrt(((own - self.centre[i]) ** 2).sum(axis=1).max())
            self.least[i] = ids[order[lo:hi]].min()
            if i < self.first_leaf:
                far = own[((own - own[0]) ** 2).sum(axis=1).argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                half = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argsort(own @ (other - far), kind="stable")]
                self.lo[2 * i + 1], self.hi[2 * i + 1] = lo, lo + half
                self.lo[2 * i + 2], self.hi[2 * i + 2] = lo + half, hi
        self.ids, self.points = ids[order], points[order]
        largest = np.abs(points).max(initial=0)
        self.largest = float(largest)

    def search(self, query_id: int, q: np.ndarray, bounds: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Merge the shard's candidates into `best`, a heap of (score, -id) with the k-th on top; `bounds` has each node's upper bound."""
        exact = self.largest * float(np.abs(q).max()) * len(q) < 2.0**53
        agenda = [(-bounds[0], 0)] if len(self.ids) else []
        while agenda:
            bound, i = heapq.heappop(agenda)
            if len(best) == k and -bound < best[0][0]:
                break
            if len(best) == k and -bound < best[0][0] + 1 and self.least[i] > -best[0][1]:
                continue  # at best a tie with a larger id
            if i < self.first_leaf:
                for c in (2 * i + 1, 2 * i + 2):
                    if self.lo[c] < self.hi[c] and (len(best) < k or bounds[c] >= best[0][0]):
                        heapq.heappush(agenda, (-min(-bound, bounds[c]), c))
                continue
            lo, hi = self.lo[i], self.hi[i]
            ids = self.ids[lo:hi]
            if exact:
                scores = self.points[lo:hi] @ q
                at = np.flatnonzero(scores >= best[0][0]) if len(best) == k else np.arange(hi - lo)
                found = zip(scores[at].tolist(), ids[at].tolist(), strict=True)
            else:
                found = ((sum(int(a) * int(b) for a, b in zip(p, q, strict=True)), v) for p, v in zip(self.points[lo:hi], ids.tolist(), strict=True))
            for s, v in found:
                if v == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -v))
                elif (s, -v) > best[0]:
                    heapq.heapreplace(best, (s, -v))
        return best

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product for each query and node, rounding included."""
        norm = np.sqrt((queries**2).sum(axis=1))[:, None]
        reach = np.sqrt((self.centre**2).sum(axis=1)) + self.radius
        return queries @ self.centre.T + norm * self.radius + 1e-9 * norm * reach + 1e-6


def _search_group(k: int):
    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """left: the shard's vectors; right: a block of queries with their k best so far."""
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            tree = BallTree(left.column("vec_id").to_numpy(), matrix(left))
            queries, ids = matrix(right), right.column("query_id").to_pylist()
            known = right.column("best").to_pylist()
            for at in range(0, len(ids), 256):
                bounds = tree.bounds(queries[at : at + 256])
                for j, b in enumerate(bounds, at):
                    before = {(x["score"], -x["vec_id"]) for x in known[j] or ()}
                    best = list(before)
                    heapq.heapify(best)
                    out += [(ids[j], -v, s) for s, v in tree.search(ids[j], queries[j], b, k, best) if (s, v) not in before]
        q, v, s = zip(*out, strict=True) if out else ((), (), ())
        clip = [max(LONG.min, min(LONG.max, int(x))) for x in s]
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(clip, pa.int64())})

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = 16_384, block_rows: int = 2_048, growth: int = 8) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each row that `is_query` (a condition on vec_id) selects.

    vectors: vec_id long, v array<double> of whole numbers, as `integer_vectors` gives them.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    rows = scratch.table(vectors.withColumn("dim", F.size("v")), "vectors")
    n, n_queries = (x or 0 for x in rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first())
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // block_rows))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("v"), F.col("dim").alias("dim"), place.alias("home"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    points = rows.withColumn("shard", place)
    found: DataFrame | None = None
    done = 0
    while done < shards:
        # shards at these distances from a query's own: 1, then growth times as many, ...
        end = min(shards, done + max(1, done * growth))
        if found is None:
            wave = asked.withColumn("best", F.lit(None).cast("array<struct<score: bigint, vec_id: bigint>>"))
        else:
            wave = asked.join(found.groupBy("query_id").agg(F.collect_list(F.struct("score", "vec_id")).alias("best")), "query_id", "left")
        wave = wave.withColumn("step", F.explode(F.sequence(F.lit(done), F.lit(end - 1)))).withColumn("shard", F.pmod(F.col("home") + F.col("step"), F.lit(shards)))
        copies = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keys = ("shard", "block", "dim")
        # names of their own on each side of the cogroup: both come from the same table
        left = copies.select(*(F.col(c).alias(c) for c in (*keys, "vec_id", "v"))).groupBy(*keys)
        right = wave.select(*(F.col(c).alias(c) for c in (*keys, "query_id", "v", "best"))).groupBy(*keys)
        got = left.cogroup(right).applyInArrow(_search_group(k), RESULT)
        merged = got if found is None else got.unionByName(found)
        # each shard returns k rows for a query at most; the best k go on
        best = merged.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score").cast("decimal(38,0)")).alias("down"), "vec_id", "score"))), 1, k).alias("best"))
        best = best.select("query_id", F.posexplode("best").alias("at", "hit"))
        last, found = found, scratch.table(best.select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score").drop("rank") if end < shards else best.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score"), "found")
        if last is not None:
            scratch.drop(last)
        done = end
    scratch.drop(rows)
    return found
