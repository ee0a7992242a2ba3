"""The golden mini corpus of FIXTURES.md §2 (six hand-checkable articles)."""

from pyspark.sql.types import LongType, StructField, StructType

from newslens.schema import ARTICLE_SCHEMA
from newslens.sources.articles import articles_from_records

NOW = "2020-11-29 00:00:00"
STOP = ["the"]

ROWS = [
    # id, title, section, source, time, depth, content
    (0, "Grid upgrade", "news", "S1", "2020-11-28 10:00:00", 1, ["power grid ", "upgrade power"]),
    (1, "Grid upgrade plan", "news", "S2", "2020-11-28 12:00:00", 2, ["power grid plan plan"]),
    (2, "Cup final", "sports", "S1", "2020-11-28 20:30:00", 1, ["cup final goal goal goal"]),
    (3, "Grid bill", "money", "S3", "2020-11-28 12:00:00", 3, ["power grid bill"]),
    (4, "Old grid", "news", None, "2020-11-25 09:15:00", 2, ["power grid upgrade old"]),
    (5, "Cup recap", "sports", "S1", "2020-11-28 23:00:00", 2, ["cup goal recap the"]),
]


def records(spark, rows=ROWS):
    data = [(f"https://x.example.com/{i}", depth, title, section, time, source, content, i)
            for i, title, section, source, time, depth, content in rows]
    schema = StructType(list(ARTICLE_SCHEMA.fields) + [StructField("ingest_pos", LongType())])
    return spark.createDataFrame(data, schema)


def articles(spark, rows=ROWS):
    return articles_from_records(records(spark, rows))
