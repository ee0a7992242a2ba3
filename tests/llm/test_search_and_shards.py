"""Operators 1 and 9 against brute force, and their edge cases."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslens.llm import sharding, topk

SCHEMA = "vec_id long, embedding array<double>, rank int, score string"


def brute(rows, k, every):
    vectors = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            w = [int(np.floor(256 * x)) for x in v]
            vectors[i] = min(vectors.get(i, w), w)
    out = set()
    for q, v in vectors.items():
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors.items() if i != q and len(w) == len(v))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)}
    return out


def search(spark, rows, k=5, every=5, **sizes):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    found = topk.top_k(topk.integer_vectors(df), F.col("vec_id") % every == 0, k, **sizes)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return {tuple(r) for r in found.collect()}


def test_top_k_over_many_shards_with_ties(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(0, 0.2, 8).round(1).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # one common vector
    assert search(spark, rows, shard_rows=60, block_rows=30) == brute(rows, 5, 5)


def test_top_k_edges(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [0.5, 9.0]), (5, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [1.0, 1.0]), (10, None), (15, []),
        (20, [float("nan"), 1.0]), (25, [None, 1.0]), (30, [float("inf"), 1.0]), (35, [1.0, 2.0, 3.0]), (8, [1e12, -1e12]),
    ]
    got = search(spark, rows)
    assert got == brute(rows, 5, 5)
    assert not any(q in (10, 15, 20, 25, 30, 35) for q, *_ in got)
    assert search(spark, []) == set()


def test_top_k_beyond_exact_doubles(spark):
    rows = [(0, [1e7 + 1, 3.0]), (1, [1e7 - 1, 2.0]), (2, [1e7, 1e-3])]
    assert search(spark, rows) == brute(rows, 5, 5)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation_is_one_to_one_and_restorable(n):
    places = sharding.permute(np.arange(n), n, seed=4)
    assert sorted(places.tolist()) == list(range(n))
    assert (sharding.restore(places, n, seed=4) == np.arange(n)).all()


def test_shards_hold_the_law_with_nulls_and_repeated_rows(spark):
    rows = [(i, f"text {i}" * (i % 7), 9) for i in range(90)] + [(None, None, 1), (None, "é", 1)] + [(5, "same", 2)] * 70_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int")
    out = sharding.shard_rows(docs, shards=7)
    got = out.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    counts = Counter(r.shard for r in got)
    assert len(counts) == 7 and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert all(r.shard == r.place % 7 and r.slot == r.place // 7 for r in got)
    again = sharding.shard_rows(docs.repartition(5), shards=7)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))


def test_no_rows_no_shards(spark):
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
