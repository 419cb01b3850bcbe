"""The registered queries of this subpackage, one per operator, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_cnn,
    credential_links,
    exact_dedup,
    hard_negatives,
    html_wrappers,
    license_join,
    merkle_manifest,
    mixing,
    nbest,
    projection_neighbours,
    simhash,
    token_counts,
    toxicity,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query("op1_html_extraction")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.main_text(table(spark, sf_dir, "pages"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query("op3_embedding_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op4_license_scan", license_join.sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.license_scan(table(spark, sf_dir, "documents"))


@query("op5_exact_dedup", exact_dedup.SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_source_mixing", mixing.sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.tree(), mixing.target_weights(docs), fraction=0.8, epochs=2, seed=42)
    return mixed.withColumn("budget", F.round("budget", 3))


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_sentencepiece_n_best")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.encode(table(spark, sf_dir, "documents"))


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query("op11_secret_scan")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credential_links.secrets(table(spark, sf_dir, "documents"))


@query("op12_merkle_manifest", merkle_manifest.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest_check(table(spark, sf_dir, "documents"))


@query("op13_hard_negatives", hard_negatives.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))
