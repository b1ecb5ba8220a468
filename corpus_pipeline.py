"""The corpus pipeline: documents to packed training sequences.

Every stage works on all rows that the one before it kept, and returns the columns of
documents; the last returns the pieces of documents in their bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelake.llm import exact_dedup, language, near_dedup, packing
from routelake.llm.util import written

#: Similarity, in percent, from which two documents are near duplicates.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts in none of the learned languages."""
    return language.keep_identified(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id stays."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity, the one with the smallest id stays."""
    return near_dedup.keep_representatives(docs, NEAR_PERCENT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's words in bins of training sequences. Duplicates are gone by now; documents that are similar
    below the limit of the stage before are kept apart: those with the same minwise shingle share no bin."""
    rows = docs.select("doc_id", "source", packing.word_count("text").alias("words"), "text")
    rows = near_dedup.with_cluster(rows, "similar")
    return packing.best_fit(rows, F.col("words"), source=F.col("source"), cluster=F.col("similar"), n_docs=docs.count())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("packing", packed),
]

#: SQL cannot express the language and near-duplicate stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
