"""Repair queries: every statement of ``sql_texts`` that fails validation is a repair job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sqltext as st
from tessera.operators import repair
from tessera.operators.repair_rounds import recorded_turns, repair_rounds
from tessera.plans import bindings

MAX_ITERATIONS = 3


def repair_jobs(spark: SparkSession, d: str) -> DataFrame:
    # The validated statements are checkpointed before the filter: a filter on a derived
    # column would otherwise be pushed below the staged validation and inline all of it.
    v = (st.with_validation(bindings.sql_texts(spark, d), "sql", "v")
         .select("id", "sql", "v_valid").checkpoint(eager=True))
    nlq = bindings.pairs(spark, d).select(F.col("pair_id").alias("id"), "nlq")
    return (v.filter(~F.col("v_valid")).join(nlq, "id")
            .select("id", "nlq", F.col("sql").alias("broken_sql")))


def q_repair_outcome(spark: SparkSession, d: str) -> DataFrame:
    return repair.repair_outcome(repair_jobs(spark, d), bindings.repair_candidates(spark, d), MAX_ITERATIONS)


def q_repair_history(spark: SparkSession, d: str) -> DataFrame:
    return repair.repair_history(repair_jobs(spark, d), bindings.repair_candidates(spark, d), MAX_ITERATIONS)


def q_repair_observations(spark: SparkSession, d: str) -> DataFrame:
    return repair.repair_observations(repair_jobs(spark, d), bindings.repair_candidates(spark, d), MAX_ITERATIONS)


def q_repair_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Round by round, with calls of tools, failed calls and the critic's answers."""
    critic = bindings.recorded_responses(spark, d).where("call = 'critic'").select("id", "text", "error")
    jobs = repair_jobs(spark, d).checkpoint(eager=True)
    turns = bindings.repair_turns(spark, d).join(jobs.select("id"), "id", "left_semi").checkpoint(eager=True)
    return repair_rounds(jobs, recorded_turns(turns, critic.join(jobs.select("id"), "id", "left_semi").checkpoint(eager=True)), MAX_ITERATIONS)
