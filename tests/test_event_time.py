"""W1, W2, W4 by event time: closed windows once, late lines counted, restarts go on."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newslens.plans import reports as RP
from newslens.streaming import event_time as ET

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def put(spark, folder, rows):
    spark.createDataFrame(rows, "ts timestamp, value string").coalesce(1).write.mode("append").parquet(folder)


def drain(spark, folder, out, ckpt, **options):
    query = ET.start_window_counts(ET.stream_lines(spark, folder, max_files_per_trigger=1), out, ckpt, available_now=True, **options)
    query.awaitTermination(120)
    assert query.exception() is None


def closed(spark, out):
    return {(r.window_start, r.word): r.n for r in ET.read_window_counts(spark, out).collect()}


def test_windows_close_behind_the_watermark_and_late_lines_are_counted(spark, scratch):
    src, out, ckpt = (os.path.join(scratch, d) for d in ("in", "out", "ckpt"))
    options = {"interval": "60 seconds", "delay": "30 seconds"}
    account = lambda: ET.line_account(spark, spark.read.parquet(src), out, ckpt).first().asDict()
    put(spark, src, [(at(5), "a b a"), (at(59), "b  7"), (at(70), "c"), (None, "x"), (at(8), None)])
    drain(spark, src, out, ckpt, **options)
    assert closed(spark, out) == {}  # the watermark stands at 40 s
    assert account() == {"lines": 3, "counted": 0, "open": 3, "late": 0}
    # not late: before the latest line, but its window is open; then the watermark passes the first window
    put(spark, src, [(at(30), "b")])
    drain(spark, src, out, ckpt, **options)
    put(spark, src, [(at(95), "d")])
    drain(spark, src, out, ckpt, **options)
    first = {(at(0), "a"): 2, (at(0), "b"): 3, (at(0), ""): 1, (at(0), "7"): 1}
    assert closed(spark, out) == first
    assert account() == {"lines": 5, "counted": 3, "open": 2, "late": 0}
    # late: three lines of the closed window, of one word; the line of the open one still counts
    put(spark, src, [(at(1), "a"), (at(2), "a"), (at(3), "a a z"), (at(61), "c")])
    drain(spark, src, out, ckpt, **options)
    assert closed(spark, out) == first
    assert account() == {"lines": 9, "counted": 3, "open": 3, "late": 3}
    # a restart with nothing new changes nothing; a far line closes the rest, and windows without lines leave no row
    drain(spark, src, out, ckpt, **options)
    put(spark, src, [(at(90_000), "end")])
    drain(spark, src, out, ckpt, **options)
    assert closed(spark, out) == first | {(at(60), "c"): 2, (at(60), "d"): 1}
    assert account() == {"lines": 10, "counted": 6, "open": 1, "late": 3}


def test_a_stream_with_a_restart_equals_the_batch_twin(spark, scratch):
    src, out, ckpt = (os.path.join(scratch, d) for d in ("in", "out", "ckpt"))
    rows = [(at(17 * i), f"w{i % 5} w{i % 3} x") for i in range(200)]
    want = {(r.window_start, r.word): r.n for r in RP.window_word_count(spark.createDataFrame(rows, "ts timestamp, value string"), "ts").collect()}
    for part in (rows[:70], rows[70:120]):
        put(spark, src, part)
    drain(spark, src, out, ckpt)
    for part in (rows[120:], [(at(10**6), "end")]):
        put(spark, src, part)
    drain(spark, src, out, ckpt)
    assert closed(spark, out) == want
    assert ET.line_account(spark, spark.read.parquet(src), out, ckpt).first().late == 0


def test_the_count_has_a_partial_phase(spark):
    lines = spark.createDataFrame([(at(1), "a")], "ts timestamp, value string")
    plan = ET.window_counts(lines)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "EvalPython" not in plan
    assert {(r.word, r.n) for r in ET.window_counts(lines).select("word", "n").collect()} == {(None, 1), ("a", 1)}
    assert ET.window_counts(lines.where(F.lit(False))).count() == 0
