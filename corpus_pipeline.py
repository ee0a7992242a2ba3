"""Corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Every stage but the last returns the columns of `documents`.  Each works on all rows of
the stage before, whole texts, and drops only what its rule names:

1. quality: documents that the positive-unlabelled classifier scores below 0.7.
2. line_dedup: lines that an earlier document (or an earlier line) has within the edit
   bound; a document all of whose lines are such repeats goes, `n_chars` is counted anew.
3. near_dedup: of each group of near copies (5-word shingles, similarity 0.8 or more) the
   document with the smallest id stays; so do rows without an id.
4. decontaminate: documents that hold a benchmark item, possibly with other slot values.
5. sentencepiece: ids of every remaining text and its decoded form.

Nulls and empty texts pass the stages with the results their operators define; empty
tables give empty results; columns beyond those of `documents` are dropped at the start.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm import decontaminate, line_dedup, near_dedup, quality, sp_codec
from newslens.llm.common import Scratch, temporary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.select(*COLUMNS)
    network = quality.train(docs, labels, learnable=~quality.held_out("id"))
    return quality.with_score(docs, network).where("quality_score >= 0.7").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(docs.select(*COLUMNS)).where("n_removed = 0 or n_removed < n_lines")
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(docs)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti").select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sp_codec.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", decontaminate_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: The quality stage scores with a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result is a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with temporary(spark):  # what a stage has put aside goes when its result is written
            docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
