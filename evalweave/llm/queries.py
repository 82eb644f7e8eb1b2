"""One query per operator over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import (
    ball_search,
    decontaminate,
    forest,
    language,
    licenses,
    line_dedup,
    lm_score,
    mixing,
    quality_model,
    quality_rules,
    simhash,
    toxicity,
    vector_codes,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the risk-controlled rules, strata by language."""
    return quality_rules.risk_controlled_rules(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the held-out fold."""
    return language.identify_language(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learned outside the held-out fold."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-label posterior and scorer of every document."""
    return quality_model.classify_quality(table(spark, sf_dir, "documents"))


@query("op5_license_scan", licenses.oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query("op4_line_dedup", line_dedup.ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated three-line passages."""
    return line_dedup.dedup_report(table(spark, sf_dir, "documents"))


@query("op3_source_mix")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all sources takes of every document."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) whose question and answer the document holds."""
    return decontaminate.find_leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_lm_score")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


@query("op11_nearest_neighbours")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding among all others."""
    return forest.nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query("op12_lexical_search", ball_search.oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ball_search.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_vector_codes", vector_codes.oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code and quantisation error of every embedding."""
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
