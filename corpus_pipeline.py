"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``. No stage can be said in SQL as a whole (trained
models, components, generated shards), so there is no ORACLE_SQL; tests hold each stage against brute force.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plaintide.llm import langid, mixing, packing, simhash, suffixes
from plaintide.session import checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text some language model accepts. NULL, empty and letterless texts go, as do texts whose
    cross-entropy is far above all that the models' own languages showed."""
    return langid.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest id."""
    return simhash.one_per_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of any passage of 200 bytes that stands anywhere else as well."""
    return suffixes.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: the taken words of each document, a second row where a second pass takes words again."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their place in sequences of 1024 ids."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages),
          ("source mix", source_mix), ("packing", sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage leaves lies in the shared checkpoint folder."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
