"""Queries over SQL text and model output rendered from ``orders`` (see bindings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sqltext as st
from tessera.plans import bindings


def q_validate_sql_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = st.with_validation(bindings.sql_texts(spark, sf_dir), "sql", "v")
    return v.select("id", F.col("v_valid").alias("valid"), F.col("v_reason").alias("reason"))


def q_strip_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.responses(spark, sf_dir).select("id", st.strip_fences("text").alias("text"))


def q_token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.predictions(spark, sf_dir).select(
        "id", F.round(st.token_similarity("pred_sql", "gold_sql"), 6).alias("token_sim"))


def q_sql_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = st.with_canonical(bindings.predictions(spark, sf_dir), "pred_sql", "pred_canonical")
    return st.with_canonical(p, "gold_sql", "gold_canonical").select("id", "pred_canonical", "gold_canonical")


def q_sql_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = st.with_comparison(bindings.predictions(spark, sf_dir), "pred_sql", "gold_sql", "c")
    return c.select("id", F.col("c_match").alias("ast_match"), F.round("c_token_sim", 6).alias("token_sim"))


def q_extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.lesson_texts(spark, sf_dir).select("id", st.extract_json("text").alias("json"))


def q_parse_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = st.with_parsed_lesson(bindings.lesson_texts(spark, sf_dir), "text", "l")
    return p.select("id", *[F.col(f"l_{f}").alias(f) for f in ("ok", "reason") + st.LESSON_FIELDS])


def q_sql_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two ways to write a statement match, and whether the second one parses."""
    c = st.with_comparison(bindings.sql_variants(spark, sf_dir), "pred_sql", "gold_sql", "c")
    return c.select("id", F.col("c_valid").alias("valid"), F.col("c_match").alias("ast_match"))
