"""The bucketed store of seen URLs."""

import os

from pyspark.sql import functions as F

from newslens.sources import seen as SEEN
from newslens.sources import sinks as SK


def urls(spark, names):
    return spark.createDataFrame([(n,) for n in names], "url string")


def test_batches_replays_and_compaction(spark, scratch):
    path = os.path.join(scratch, "seen")
    left = lambda names, batch: sorted(r.url or "-" for r in SEEN.unseen_in_store(urls(spark, names), path, batch, 8).collect())
    a, b = [f"u{i}" for i in range(50)], [f"u{i}" for i in range(40, 80)]
    assert left(a, "1") == sorted(a)
    SEEN.mark_seen(urls(spark, a + a), path, "1", 8)
    assert left(a, "1") == sorted(a)  # run again: only other batches count
    assert left(b, "2") == sorted(b[10:])
    SEEN.mark_seen(urls(spark, [*b[10:], None]), path, "2", 8)
    before = sorted(map(tuple, SEEN.read_seen(spark, path).collect()))
    SEEN.mark_seen(urls(spark, b[10:]), path, "2", 8)
    assert sorted(map(tuple, SEEN.read_seen(spark, path).collect())) == before and len(before) == 80
    SEEN.compact(spark, path)
    SEEN.compact(spark, path)
    folded = SEEN.read_seen(spark, path)
    assert folded.count() == 80 and {r.batch_id for r in folded.collect()} == {SEEN.COMPACTED}
    assert left([*a, *b, "new", None], "3") == ["-", "new"]
    assert not os.path.exists(f"{path}/_compact")


def test_only_the_buckets_of_the_batch_are_read(spark, scratch):
    path = os.path.join(scratch, "seen")
    SEEN.mark_seen(urls(spark, [f"u{i}" for i in range(400)]), path, "1", 32)
    found = SEEN.unseen_in_store(urls(spark, ["u7", "new"]), path, "2", 32)
    assert [r.url for r in found.collect()] == ["new"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan or "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "EvalPython" not in plan
    own = {r.bucket for r in SEEN.with_bucket(urls(spark, ["u7", "new"]), 32).collect()}
    files = {f for f in SEEN.read_seen(spark, path).where(F.col("bucket").isin(sorted(own))).inputFiles() if any(f"bucket={b}/" in f for b in own)}
    read = SEEN.read_seen(spark, path).where(F.col("bucket").isin(sorted(own))).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f for r in read} <= files and len(read) <= 2


def test_the_article_store_is_the_same_with_it(spark, scratch):
    rows = [(i, f"u{i % 30}", f"t{i}") for i in range(90)]
    new = spark.createDataFrame(rows, "page_id long, url string, title string")
    got = []
    for seen in (None, os.path.join(scratch, "seen")):
        store = os.path.join(scratch, f"store{bool(seen)}")
        for batch in ("1", "2", "2", "1"):
            own = new.where(f"page_id % 3 < {batch}")
            SK.append_new_articles(own, store, batch_id=batch, seen_path=seen)
        got.append(sorted((r.page_id, r.url, r.title, str(r.batch_id)) for r in spark.read.parquet(store).collect()))
    assert got[0] == got[1] and len({u for _, u, *_ in got[0]}) == len(got[0]) == 20
