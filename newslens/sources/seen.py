"""A store of seen URLs that a batch reads only in part.

URLs fall into buckets by their hash, and the store has a folder per bucket and batch:
`bucket=17/batch_id=b/`.  A batch looks up its own buckets only (their numbers are
a literal filter on the partition column, so Spark lists and reads no other
folder), and the anti-join meets bucket by bucket.  A batch of few URLs against a
store of many so reads a few folders; one that touches all reads all, once.

Replays: a batch is compared with the other batches only and its folders are
replaced, so running it again changes nothing.  `compact` folds the batches of each bucket
into one; a batch that is run again after that finds its URLs seen.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1024
COMPACTED = "_all"
STORE_SCHEMA = "url string, bucket int, batch_id string"


def with_bucket(urls: DataFrame, buckets: int = BUCKETS, col: str = "url") -> DataFrame:
    return urls.withColumn("bucket", F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int"))


def read_seen(spark: SparkSession, path: str) -> DataFrame:
    """(url, bucket, batch_id) of the store; empty where nothing has been stored yet."""
    try:
        return spark.read.schema(STORE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if (e.getCondition() or "") != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORE_SCHEMA)


def unseen_in_store(new: DataFrame, path: str, batch_id: str, buckets: int = BUCKETS, col: str = "url") -> DataFrame:
    """The rows of `new` whose URL no other batch has stored."""
    spark = new.sparkSession
    keyed = with_bucket(new, buckets, col)
    touched = [r.bucket for r in keyed.select("bucket").distinct().collect()]  # `buckets` numbers at most
    stored = read_seen(spark, path).where(F.col("bucket").isin(touched) & (F.col("batch_id") != F.lit(batch_id)))
    stored = stored.select(F.col("url").alias("_seen"), F.col("bucket").alias("_bucket")).distinct()
    return keyed.join(stored, (F.col("bucket") == F.col("_bucket")) & (F.col(col) == F.col("_seen")), "left_anti").drop("bucket")


def mark_seen(urls: DataFrame, path: str, batch_id: str, buckets: int = BUCKETS, col: str = "url") -> None:
    """Store the batch's URLs, in place of what it has stored before; a bucket's rows meet in one task, so it is one file."""
    own = with_bucket(urls.select(F.col(col).alias("url")).where("url is not null").distinct(), buckets)
    (own.withColumn("batch_id", F.lit(batch_id)).repartition("bucket").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(path))


def compact(spark: SparkSession, path: str) -> None:
    """Fold the batches of every bucket into one.

    The folded folders are written beside the old ones, which go only then: a failure in
    between leaves URLs stored twice, which no look-up notices, and the next call ends it.
    """
    stored = read_seen(spark, path)
    old = [(r.bucket, r.batch_id) for r in stored.where(F.col("batch_id") != COMPACTED).select("bucket", "batch_id").distinct().collect()]  # one row a folder
    if not old:
        return
    staged = f"{path}/_compact"  # hidden from readers of the store
    stored.where(F.col("bucket").isin(sorted({b for b, _ in old}))).select("url", "bucket").distinct().write.mode("overwrite").parquet(staged)
    folded = spark.read.schema("url string, bucket int").parquet(staged).withColumn("batch_id", F.lit(COMPACTED))
    (folded.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(path))
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in (*(f"bucket={b}/batch_id={i}" for b, i in old), "_compact"):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}"), True)
