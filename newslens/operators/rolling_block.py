"""T8 / T9 / R7 kept up to date: block keywords from decremental aggregates.

The latest `last_n` articles form one block, all earlier ones stand apart.  When articles
arrive, some leave the block, and only they change what is known of the earlier ones:
the document frequency of their terms and the number of articles.  A store keeps, per
version, the block's own term counts, the frequencies that this version adds, and the
number of earlier articles; a batch reads the block and the new articles, never the
corpus, and block keywords read the frequencies of the block's terms.

Folders: `docs/v=N`, `block/v=N`, `df/v=N`, and `meta/v=N`, which is written last: a version without it
does not count, so a batch that failed can be run again, and one that is in the store
already is left out.  Every `fold_every` versions the frequencies are folded into one table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from newslens import schema as S
from newslens.operators import text as TX
from newslens.session import kept, reuse

BLOCK = "doc_id long, term string, tf long"
META = "version int, batch_id string, base int, earlier long"


@dataclass(frozen=True)
class RollingBlock:
    """The store at `path`; all batches must use the same parameters."""
    spark: SparkSession
    path: str
    last_n: int = S.BLOCK_LAST_N
    stopwords: TX.StopWords = S.DEFAULT_STOPWORDS
    mode: str = "words"
    fold_every: int = 16

    def _versions(self) -> list[Row]:
        """One row per batch applied, latest first."""
        try:
            return self.spark.read.schema(META).parquet(f"{self.path}/meta/*").orderBy(F.col("version").desc()).collect()
        except AnalysisException as e:
            if (e.getCondition() or "") != "PATH_NOT_FOUND":
                raise
            return []

    def _read(self, part: str, version: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}/v={version}")

    def _frequencies(self, now: Row) -> DataFrame:
        """(term, df) over the earlier articles, still to be summed."""
        return self.spark.read.schema("term string, df long").parquet(*[f"{self.path}/df/v={v}" for v in range(now.base, now.version + 1)])

    def add(self, articles: DataFrame, batch_id: str) -> bool:
        """Take in a batch of articles (doc_id, text), ids new to the store; False if the batch was there already."""
        versions = self._versions()
        if any(v.batch_id == batch_id for v in versions):
            return False
        now = versions[0] if versions else None
        version = now.version + 1 if now else 1
        with kept():
            tf = reuse(TX.term_freq(TX.tokens(articles, self.mode, self.stopwords)))
            docs = articles.select(F.col("doc_id").cast("long").alias("doc_id"))
            rows = tf.select(F.col("doc_id").cast("long").alias("doc_id"), "term", "tf")
            if now:
                docs = docs.unionByName(self._read("docs", now.version, "doc_id long"))
                rows = rows.unionByName(self._read("block", now.version, BLOCK))
            docs = reuse(docs)
            start = docs.orderBy(F.col("doc_id").desc()).limit(self.last_n).agg(F.min("doc_id")).first()[0]
            stays = F.col("doc_id") >= F.lit(start) if start is not None else F.lit(False)
            left = rows.where(~stays).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            fold = now is not None and version - now.base >= self.fold_every
            if fold:
                left = left.unionByName(self._frequencies(now)).groupBy("term").agg(F.sum("df").alias("df"))
            docs.where(stays).write.mode("overwrite").parquet(f"{self.path}/docs/v={version}")
            rows.where(stays).write.mode("overwrite").parquet(f"{self.path}/block/v={version}")
            left.write.mode("overwrite").parquet(f"{self.path}/df/v={version}")
            earlier = (now.earlier if now else 0) + docs.where(~stays).count()
        meta = [(version, batch_id, version if fold or not now else now.base, earlier)]
        self.spark.createDataFrame(meta, META).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta/v={version}")
        return True

    def last_articles(self) -> DataFrame:
        """(doc_id) of the block."""
        return self._read("docs", self._versions()[0].version, "doc_id long")

    def weights(self) -> DataFrame:
        """T8 for the block: (term, tf, df, tfidf); df counts the block as one article."""
        now = self._versions()[0]
        own = self._read("block", now.version, BLOCK).groupBy("term").agg(F.sum("tf").alias("tf"))
        df = self._frequencies(now).groupBy("term").agg(F.sum("df").alias("_df"))
        rows = own.join(df, "term", "left").select("term", "tf", (F.coalesce("_df", F.lit(0)) + 1).alias("df"))
        return rows.withColumn("tfidf", F.col("tf") * TX.idf_expr(F.lit(now.earlier + 1), F.col("df")))

    def keywords(self, k: int = S.TOP_KEYWORDS) -> DataFrame:
        """(rank, term, tf, tfidf) of the block."""
        order = [F.col("w9").desc(), F.col("term").asc()]
        top = TX.with_rank_key(self.weights()).orderBy(*order).limit(k)
        # at most k rows
        return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "term", "tf", "tfidf")
