"""A file of one row group has many splits and all its rows in one of them: texts are dealt by their bytes."""

from pyspark.sql import functions as F

from newslens.session import spread_texts
from newslens.sources.articles import articles_from_tables


def _per_partition(df):
    return [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_one_row_group_is_dealt_over_the_cores(spark, scratch):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2((F.col("id") * 7 + i).cast("string"), 256) for i in range(140)]).alias("text"),
                                    F.lit("en").alias("lang"), F.lit("s").alias("source"))
    rows.coalesce(1).write.parquet(f"{scratch}/documents.parquet")
    spark.range(10).select(F.col("id").alias("event_id"), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("ts")).coalesce(1).write.parquet(f"{scratch}/events.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 256 << 10)
    try:
        docs = spark.read.parquet(f"{scratch}/documents.parquet")
        assert len(_per_partition(docs)) < docs.rdd.getNumPartitions()
        arts = articles_from_tables(spark, scratch)
        assert max(_per_partition(arts)) < 2000 / min(4, spark.sparkContext.defaultParallelism)
        assert arts.count() == 2000 and arts.where("pub_ts is not null").count() == 9
        small = spread_texts(docs, "doc_id", text_bytes=256 << 10)
        assert small.rdd.getNumPartitions() >= 60 and small.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
