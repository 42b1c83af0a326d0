"""From raw documents to token ids: language, near duplicates, secrets, mixing, pieces.

Every stage takes the documents its predecessor kept and returns documents with all their columns; the last returns
their encoding. A null in any column, empty and long texts, repeated rows and empty tables are handled as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scoremill.llm import language, mixing, neardup, pieces, secrets
from scoremill.llm.words import table
from scoremill.session import stage


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a text or a letter go, a missing lang is filled."""
    return language.keep_known(docs)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix serves them: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix, with further segmentations."""
    return pieces.encode(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("pieces", piece_stage),
]

# Learned models and shuffles by hash have no SQL twin; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
