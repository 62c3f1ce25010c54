"""The corpus pipeline: language ID, exact dedup, near-duplicate join, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's documents.  A stage starts with executors that have given back the memory of the one before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from meridion.llm import exactdedup, langid, mixing, neardup, packing
from meridion.llm.common import give_back, table, work_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a recognised language; null texts and texts without a letter go."""
    give_back(spark)
    return langid.in_known_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    give_back(spark)
    return exactdedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more, the one with the smallest doc_id."""
    give_back(spark)
    return neardup.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in proportions 3, 1, 2, ...: a row for each time a document is taken."""
    give_back(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    give_back(spark)
    return packing.pack(docs, with_ids=False).drop("ids")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("pack", pack)]

#: A trained network and a tokenizer are no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{work_folder(spark)}/meridion/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
