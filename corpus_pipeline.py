"""Corpus pipeline: raw documents to packed training sequences.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pkgscreen.config import ship
from pkgscreen.llm import importance, line_dedup, near_dedup, packing, quality_rules
from pkgscreen.llm.base import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance classifier fitted on ``labels``; rejected documents go."""
    ship(spark)
    return importance.classify(docs, table(spark, sf_dir, "labels"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules with thresholds per language and source; rejected documents go."""
    ship(spark)
    return quality_rules.apply(docs)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share are taken out of the texts."""
    ship(spark)
    return line_dedup.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship(spark)
    return near_dedup.apply(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of the remaining documents in sequences, as pieces with their places."""
    ship(spark)
    return packing.pack(packing.tokenize(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_filter),
    ("line_dedup", line_filter),
    ("near_dedup", near_duplicates),
    ("best_fit_packing", packed_sequences),
]

# A fitted classifier, MinHash and a tokenizer are not SQL: tests hold each stage against brute force, or (both classifiers) against the verdicts of their models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
