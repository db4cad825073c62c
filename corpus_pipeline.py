"""Clean, deduplicate and pack `documents`.  Each stage works on what the one before kept, written as Parquet and read again.

Every stage takes nulls in any column, repeated rows, texts of any length, further columns and empty tables, which give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from idloom.llm import exact_dedup, lang_id, near_dup, packing, toxicity
from idloom.llm._scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what has no letters, null and empty texts among it, or fits no language."""
    return lang_id.accept_languages(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop toxic documents, by a model trained on the labelled ones among these.  Null and empty texts stay, and all without labels."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of all documents with the same bytes, that of the smallest id.  Null texts stay; a null id comes after all others."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that of the smallest id.  Texts without words, and rows without an id, stay."""
    return near_dup.near_dedup(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every token of the documents left in a training sequence.  An empty text has one token, a null text none."""
    return packing.best_fit_packing(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: Trained models and MinHash have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage, from the table documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
