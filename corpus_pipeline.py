"""Training-corpus pipeline over ``documents``: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from tidemark.llm import exact_dedup, mixing, nbest, simhash, toxicity  # noqa: E402
from tidemark.llm.common import table  # noqa: E402
from tidemark.session import scratch_path  # noqa: E402


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go (operator 6), learned from the labels of the folder."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text the smallest id stays (operator 5)."""
    return exact_dedup.keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates the smallest id stays (operator 10)."""
    return simhash.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the token budget of their domain, language and source (operator 7); one epoch, so none twice."""
    return mixing.keep_mixed(docs, mixing.tree(), mixing.target_weights(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document with its N-best scores and the decoding check (operator 9)."""
    return nbest.encode(docs)


STAGES = [("toxicity", clean), ("exact_dedup", exact), ("simhash_near_dedup", near), ("source_mixing", mixed), ("sentencepiece", encoded)]

#: The toxicity stage scores with a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
