"""Corpus preparation as five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; ``run`` writes each result as Parquet to the shared folder
(``spark.checkpoint.dir``) and rereads it as the next stage's documents.

1. quality: documents that the quality rules reject go.
2. near_duplicates: of documents joined by n-gram Jaccard links (five words,
   0.75 or more) the one with the smallest id stays.
3. decontamination: documents with a passage close to a benchmark item go.
4. secrets: secret values in the text are masked; all documents stay.
5. tokens: ids of every text, and the text that they decode to as a digest.

Stages 1 to 4 return the columns of ``documents``; the text of stage 4 is masked
and ``n_chars`` follows it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bugsift.llm import decontaminate, ngram_join, quality_rules, secret_scan, sentencepiece_bpe
from bugsift.llm.common import prepare
from bugsift.llm.queries import piece_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redact(docs)
    size = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return masked.withColumn("n_chars", size) if "n_chars" in docs.columns else masked


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip(docs, piece_model())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

# Masking, merging and edit distances have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
