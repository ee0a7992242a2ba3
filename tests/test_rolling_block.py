"""T8 / T9 / R7 kept by deltas, against recomputation over all articles."""

import os
import random

import pytest
from pyspark.sql import functions as F

from newslens.operators import ranking as R
from newslens.operators import text as TX
from newslens.operators.rolling_block import RollingBlock

WORDS = [f"w{i}" for i in range(40)] + ["the", "x y", ""]


@pytest.mark.parametrize("last_n", [7])
def test_random_batches_equal_recomputation(spark, scratch, last_n):
    r = random.Random(last_n)
    block = RollingBlock(spark, os.path.join(scratch, "block"), last_n, fold_every=5)
    rows, ids = [], list(range(1, 400))
    for batch in range(20):
        # mostly rising ids, sometimes one far behind; batches smaller and larger than the block, and empty ones
        size = r.choice([0, 1, 3, 9, 20])
        own = [ids.pop(0 if r.random() < 0.9 else r.randrange(min(30, len(ids)))) for _ in range(size)]
        own = [(i, " ".join(r.choices(WORDS, k=r.randint(0, 12)))) for i in own]
        frame = spark.createDataFrame(own, "doc_id long, text string")
        assert block.add(frame, str(batch))
        if batch % 4 == 1:
            assert not block.add(frame, str(batch))  # run again
        rows += own
        if batch % 3 == 2:
            whole = spark.createDataFrame(rows, frame.schema)
            want = {(x.rank, x.term, x.tf, round(x.tfidf, 9)) for x in TX.block_keywords(whole, last_n=last_n).collect()}
            assert {(x.rank, x.term, x.tf, round(x.tfidf, 9)) for x in block.keywords().collect()} == want
            assert sorted(x.doc_id for x in block.last_articles().collect()) == sorted(i for i, _ in rows)[-last_n:]


def test_a_version_without_its_record_does_not_count(spark, scratch):
    block = RollingBlock(spark, os.path.join(scratch, "block"), 2)
    frame = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    block.add(frame((1, "a b"), (2, "b"), (3, "c c")), "1")
    # a batch that died before its record was written
    frame((9, "z")).withColumn("term", F.lit("z")).withColumn("tf", F.lit(1).cast("long")).select("doc_id", "term", "tf").write.parquet(f"{block.path}/block/v=2")
    block.add(frame((4, "a c")), "2")
    got = {x.term: (x.tf, x.df) for x in block.weights().collect()}
    assert got == {"c": (3, 1), "a": (1, 2)}
    assert R.last_n(frame((1, ""), (4, ""), (3, "")), 2).count() == block.last_articles().count() == 2


def test_a_batch_reads_the_block_and_not_the_corpus(spark, scratch):
    block = RollingBlock(spark, os.path.join(scratch, "block"), 3, fold_every=3)
    for b in range(7):
        block.add(spark.createDataFrame([(10 * b + i, f"t{b} u{i}") for i in range(5)], "doc_id long, text string"), str(b))
    now = block._versions()[0]
    assert (now.version, now.base, now.earlier) == (7, 7, 32)
    assert block._read("block", 7, "doc_id long, term string, tf long").select("doc_id").distinct().count() == 3
    assert {x.term: x.df for x in block._frequencies(now).collect()}["t0"] == 5
