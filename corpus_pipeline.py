"""Corpus cleaning and packing as a chain of stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of
``documents``: what a stage drops or shortens is gone for the next one. The stages use the
operators' production parameters, as their queries do.

Null texts have no words, so the first stage drops them; rows that repeat an id and text are one
document from the second stage on; extra columns pass through whatever their names; empty
tables stay empty; texts of any length are handled whole.

Not stated in SQL (ORACLE_SQL is None): the first stage trains a forest, the second and third
need signatures and components, the last a tokenizer. ``tests/llm`` holds each stage against a
brute-force version instead.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from marlpit.llm import lines, mixing, packing, quality, simhash
from marlpit.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the isolation forest let pass."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier document's or their own; those with nothing else go."""
    return lines.without_repeats(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: candidates by SimHash with
    pigeonring filtering and by MinHash bands, verified by 5-word Jaccard similarity of 0.8 or more."""
    return simhash.keep_first(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in training order, once for each time the mix reads them."""
    return mixing.mixed_rows(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two of tokens, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    folder = f"{shared_folder(spark)}/corpus-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
