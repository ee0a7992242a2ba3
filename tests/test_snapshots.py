"""Versions that appear together; A5: stored distinct-count sketches."""

import os

import pytest
from pyspark.sql import functions as F

from newslens.operators import counts as C
from newslens.sources import snapshots as SN

SCHEMA = "k int"


def rows(spark, path, part, **version):
    return sorted(r.k for r in SN.read_part(spark, path, part, SCHEMA, **version).collect())


def test_a_failure_between_the_parts_leaves_the_old_version(spark, scratch):
    path = os.path.join(scratch, "reports")
    frame = lambda *k: spark.createDataFrame([(x,) for x in k], SCHEMA)
    with pytest.raises(LookupError):
        SN.read_part(spark, path, "a", SCHEMA)
    assert SN.publish(spark, path, "t1", {"a": frame(1), "b": frame(10)}) == 1
    broken = frame(3).select(F.raise_error(F.lit("stop")).cast("int").alias("k"))
    with pytest.raises(Exception, match="stop"):
        SN.publish(spark, path, "t2", {"a": frame(2, 3), "b": broken})
    assert rows(spark, path, "a") == [1] and rows(spark, path, "b") == [10]
    assert SN.publish(spark, path, "t3", {"a": frame(4), "b": frame()}) == 2
    assert rows(spark, path, "a") == [4] and rows(spark, path, "b") == [] and rows(spark, path, "a", version=1) == [1]
    assert [(v.version, v.at) for v in SN.versions(spark, path)] == [(2, "t3"), (1, "t1")]
    SN.publish(spark, path, "t4", {"a": frame(5), "b": frame(6)})
    SN.drop_old(spark, path, keep=2)
    assert len(os.listdir(f"{path}/versions")) == 2 and rows(spark, path, "a", version=2) == [4]
    with pytest.raises(LookupError):
        SN.read_part(spark, path, "a", SCHEMA, version=1)
    with pytest.raises(ValueError):
        SN.publish(spark, path, "t5", {"a/b": frame(1)})


def test_sketches_of_days_are_merged_within_the_stated_error(spark):
    urls = spark.range(60_000).select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("day"), "id").where("(id + day) % 3 > 0").selectExpr("day", "concat('u', (id + 15000 * day) % 90000) url")
    kept = C.url_sketches(urls, "day").cache()
    assert kept.count() == 4 and kept.agg(F.max(F.length("sketch"))).first()[0] < 4_200
    exact = urls.select("url").distinct().count()
    got = C.merged_distinct(kept).first().n_urls
    assert abs(got - exact) <= 3 * 1.04 / 2 ** (C.SKETCH_LOG / 2) * exact
    by_day = {r.day: r.n_urls for r in C.merged_distinct(kept, "day").collect()}
    for r in urls.groupBy("day").agg(F.countDistinct("url").alias("n")).collect():
        assert abs(by_day[r.day] - r.n) <= 3 * 1.04 / 2 ** (C.SKETCH_LOG / 2) * r.n
    kept.unpersist()


def test_the_published_parts_are_worked_out_once(spark, monkeypatch):
    from conftest import SF_SMALL
    from newslens.plans import stored_queries as SQ

    published, publish = [], SN.publish
    monkeypatch.setattr(SN, "publish", lambda spark, path, at, parts: published.append(parts) or publish(spark, path, at, parts))
    assert SQ.s6_snapshot(spark, SF_SMALL).count() > 100
    assert len(published) == 3 and published[0]["window"] is published[1]["window"]
    assert all(part.storageLevel.useMemory for part in published[1].values())
