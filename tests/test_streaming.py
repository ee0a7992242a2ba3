"""W1-W4 with S7/S8: batches by arrival, replays and restarts are no-ops, nothing is late or pending."""

import os

from pyspark.sql import functions as F

from newslens.operators import counts as C
from newslens.streaming import word_history as WC

T0 = 1_617_235_200


def _write(folder, name, text, mtime=T0):
    p = os.path.join(folder, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    os.utime(p, (mtime, mtime))


def _run(spark, src, hist, ckpt, counts, **options):
    q = WC.start_word_history(spark, src, hist, ckpt, counts, available_now=True, **options)
    q.awaitTermination(120)
    assert q.exception() is None


def _frames(spark, hist):
    frames = {}
    for r in WC.read_history_table(spark, hist).collect():
        frames.setdefault(r.batch_time, []).append((r.rank, r.keyword, r.n))
    return [sorted(frames[k]) for k in sorted(frames)]


def test_every_batch_is_counted_when_it_arrives(spark, scratch):
    src, hist, ckpt, counts = (os.path.join(scratch, d) for d in ("in", "hist", "ckpt", "counts"))
    os.makedirs(src)
    _write(src, "a.txt", "x y x")
    _write(src, "b.txt", "x  7", T0 + 5)
    _write(src, "ignored.json", "z z z")
    _run(spark, src, hist, ckpt, counts)
    # a one-batch drain leaves nothing pending
    assert _frames(spark, hist) == [[(1, "x", 3), (2, "y", 1)]]
    # All counts of the batch, the empty word and "7" included (W1 = A1)
    got = {r.word: r.n for r in spark.read.parquet(counts).collect()}
    batch = spark.createDataFrame([("x y x",), ("x  7",)], "value string")
    assert got == {"x": 3, "y": 1, "": 1, "7": 1} == {r.word: r.n for r in C.word_count(batch).collect()}
    # a restart with nothing new changes nothing
    _run(spark, src, hist, ckpt, counts)
    assert len(_frames(spark, hist)) == 1
    # a file far ahead in time, then one far behind: both count on arrival
    _write(src, "c.txt", "ahead", T0 + 50_000)
    _run(spark, src, hist, ckpt, counts)
    _write(src, "d.txt", "late late", T0 - 50_000)
    _run(spark, src, hist, ckpt, counts)
    assert _frames(spark, hist) == [[(1, "x", 3), (2, "y", 1)], [(1, "ahead", 1)], [(1, "late", 2)]]
    # A batch without countable words leaves no entry
    _write(src, "e.txt", "12 34")
    _run(spark, src, hist, ckpt, counts)
    assert len(_frames(spark, hist)) == 3


def test_a_replayed_batch_writes_the_same_keys(spark, scratch):
    hist, counts = os.path.join(scratch, "hist"), os.path.join(scratch, "counts")
    sink = WC.history_sink(hist, counts)
    first, second = (spark.createDataFrame([(t,)], "value string") for t in ("a b a", "c"))
    sink(first, 0)
    sink(second, 1)
    before = sorted(map(tuple, WC.read_history_table(spark, hist).collect()))
    sink(first, 0)
    assert sorted(map(tuple, WC.read_history_table(spark, hist).collect())) == before and len(before) == 3
    assert spark.read.parquet(counts).agg(F.sum("n")).first()[0] == 4
    # two batches of one second keep keys of their own
    assert len({k for k, *_ in before}) == 2


def test_upsert_is_idempotent(spark, scratch):
    path = os.path.join(scratch, "hist")
    a = spark.createDataFrame([("2020-11-29 22:30:01", 1, "a", 5), ("2020-11-29 22:30:21", 1, "b", 2), ("2020-11-30 00:00:00", 1, "d", 1)],
                              "batch_time string, rank int, keyword string, n long")
    WC.upsert_history(a, path)
    WC.upsert_history(a, path)
    assert spark.read.parquet(path).count() == 3
    b = spark.createDataFrame([("2020-11-29 22:30:21", 1, "c", 7)], a.schema)
    WC.upsert_history(b, path)
    got = sorted((r.batch_time, r.keyword) for r in WC.read_history_table(spark, path).collect())
    assert got == [("2020-11-29 22:30:01", "a"), ("2020-11-29 22:30:21", "c"), ("2020-11-30 00:00:00", "d")]
    # one partition a day, and no staging left
    assert sorted(d for d in os.listdir(path) if d.startswith(("day=", "_staging"))) == ["day=2020-11-29", "day=2020-11-30"]


def test_batch_history_top_k(spark):
    rows = [("t", f"w{i}", i) for i in range(30)] + [("t", "12", 99)]
    top = WC.batch_history(spark.createDataFrame(rows, "batch_time string, word string, n long"), 20).orderBy("rank").collect()
    assert [r.keyword for r in top][:3] == ["w29", "w28", "w27"] and len(top) == 20
