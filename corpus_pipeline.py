"""Corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``; packing returns the pieces of its sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm import minhash, mixing, packing, quality, queries, secrets
from shoplens.llm.common import read_table, stage_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules accept."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate group
    (distinct 5-word shingles, similarity of 0.8 or more)."""
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, mixed to the target weights from at most two epochs."""
    levels = {"domain": queries.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, levels, 1.0, queries.mix_weights())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None      # the stages cannot be expressed in SQL; tests compare them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
