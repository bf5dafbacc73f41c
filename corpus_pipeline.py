"""Corpus pipeline over `documents`: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.llm import jaccard_join, mixing, pieces, quality_rules, secrets_scan
from fleetgauge.llm.tables import small_batches, table
from fleetgauge.session import prepare, work_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    _settings(spark)
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that with the smallest doc_id."""
    _settings(spark)
    return jaccard_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked, and n_chars follows."""
    _settings(spark)
    return secrets_scan.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    _settings(spark)
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they give it back, beside the columns of documents but the text."""
    _settings(spark)
    return pieces.encode(docs, check=True).drop("text")


def _settings(spark: SparkSession) -> None:
    prepare(spark)
    small_batches(spark)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secrets),
    ("mixing", mixture),
    ("sentencepiece", tokens),
]

# Banding, structural checks and piece encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again as the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
