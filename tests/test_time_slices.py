"""W1 by event time over stored lines: a half comes in slices of time, and the state store holds no more than two of them."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newslens.plans import stored_queries as SQ
from newslens.sources import articles as AR

T0 = datetime(2024, 1, 1)


def tables(spark, folder, n=120):
    # in no order of time; three articles without a time
    docs = [(i, f"w{i % 7} common line{i}\nend", "en", "src1", 10) for i in range(n + 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    events = [(i, T0 + timedelta(hours=i * 37 % n)) for i in range(n)]
    spark.createDataFrame(events, "event_id long, ts timestamp").write.parquet(f"{folder}/events.parquet")
    return folder


def test_slices_are_whole_and_in_order_and_few_windows_wait(spark, scratch, monkeypatch):
    d = tables(spark, f"{scratch}/tables")
    dated = AR.articles_from_tables(spark, d).where("pub_ts is not null")
    lines, again = dated.count(), dated.where("doc_id % 50 = 0").count()
    monkeypatch.setattr(SQ, "SLICE_BYTES", 40)
    counts, runs, start = SQ.w1_event_time_counts(spark, d), [], SQ.ET.start_window_counts

    def started(*a, **b):
        runs.append(start(*a, **b))
        return runs[-1]

    monkeypatch.setattr(SQ.ET, "start_window_counts", started)
    assert SQ.w1_late_lines(spark, d).first().asDict() == {"lines": lines + 1 + again, "counted": lines, "open": 1, "late": again}
    assert counts.where("word = 'common'").agg(F.sum("n")).first()[0] == lines
    # the second start: many batches, none of which holds a half's windows
    held = [p["stateOperators"][0]["numRowsTotal"] for p in runs[1].recentProgress if p["stateOperators"]]
    assert len(held) > 4 and max(held) < sum(p["stateOperators"][0]["numRowsUpdated"] for p in runs[1].recentProgress if p["stateOperators"]) / 2
