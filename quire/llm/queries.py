"""Queries of the training-data operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, cotraining, divergence, language, lexical, lm, mixing, near_dup, quality_rules, substrings, toxicity, vector_dup, wrappers
from .common import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.query(read_table(spark, sf_dir, "documents"))


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.query(spark, read_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.query(read_table(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.query(read_table(spark, sf_dir, "documents"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.query(read_table(spark, sf_dir, "documents"))


def op8_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dup.query(read_table(spark, sf_dir, "embeddings"))


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(spark, read_table(spark, sf_dir, "documents"))


def op10_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(read_table(spark, sf_dir, "documents"))


def op11_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.query(read_table(spark, sf_dir, "pages"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.query(read_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_cotraining, op4_byte_bpe, op5_suffix_dedup, op6_lm_scores, op7_order_minhash, op8_vector_graph, op9_pfair_mixing, op10_weak_supervision, op11_html_wrappers, op12_divergence, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    """Those that SQL expresses; tests/llm holds brute force, round trips and held-out accuracy for the others."""
    return {"op10_weak_supervision": quality_rules.oracle(), "op12_divergence": divergence.oracle(), "op13_ranked_search": lexical.oracle()}
