"""Schemas of the record tables (explicit, nothing inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

PAIRS = T.StructType([
    T.StructField("pair_id", T.LongType(), False),
    T.StructField("nlq", T.StringType(), False),
    T.StructField("sql", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), True),
])

LESSONS = T.StructType([
    T.StructField("lesson_id", T.LongType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("trigger", T.StringType(), False),
    T.StructField("diagnosis", T.StringType(), False),
    T.StructField("fix_rule", T.StringType(), False),
    T.StructField("error_category", T.StringType(), False),
    T.StructField("example", T.StringType(), False),
    T.StructField("run_id", T.LongType(), True),
    T.StructField("ordinal", T.LongType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])

TRAINING_RUNS = T.StructType([
    T.StructField("run_id", T.LongType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("metrics", T.StringType(), True),
    T.StructField("event_time", T.TimestampType(), False),
])

EVAL_RESULTS = T.StructType([
    T.StructField("result_id", T.LongType(), False),
    T.StructField("training_run_id", T.LongType(), False),
    T.StructField("nlq", T.StringType(), True),
    T.StructField("gold_sql", T.StringType(), True),
    T.StructField("pred_sql_1", T.StringType(), True),
    T.StructField("pred_sql_2", T.StringType(), True),
    T.StructField("pass1", T.BooleanType(), False),
    T.StructField("pass2", T.BooleanType(), False),
    T.StructField("hard_failure", T.BooleanType(), False),
    T.StructField("used_lesson_id", T.LongType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])

VECTORS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
])

HITS = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("rank", T.LongType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("score", T.DoubleType(), False),
])
