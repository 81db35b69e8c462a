"""Stored corpora of examples and lessons: vectors beside their records, addressed by content.

An example is its question and SQL, a lesson its six fields; a row that is stored already is not
embedded again. What is searched is the table itself (``KeyedTable.rows``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.embed import hash_embed
from tessera.functions.sqltext import LESSON_FIELDS
from tessera.sources.keyed import KEY, Appended, KeyedTable
from tessera.sources.pairs import content_key

Embed = Callable[[Column], Column]

VECTOR = T.StructField("embedding", T.ArrayType(T.FloatType()))
EXAMPLES = T.StructType([T.StructField("pair_id", T.LongType()), T.StructField("nlq", T.StringType()), T.StructField("sql", T.StringType()), VECTOR])
LESSONS = T.StructType([T.StructField("lesson_id", T.LongType()), *[T.StructField(f, T.StringType()) for f in LESSON_FIELDS], VECTOR])


def examples_table(spark: SparkSession, path: str, digits: int = 2) -> KeyedTable:
    return KeyedTable(spark, path, EXAMPLES, digits)


def lessons_table(spark: SparkSession, path: str, digits: int = 2) -> KeyedTable:
    return KeyedTable(spark, path, LESSONS, digits)


def lesson_key() -> Column:
    return F.md5(F.to_json(F.struct(*LESSON_FIELDS)))


def _with_vector(table: KeyedTable, text: str, embed: Embed, batch: DataFrame, commit: str | None, order: str) -> Appended:
    blank = batch.withColumn("embedding", F.lit(None).cast(VECTOR.dataType))
    return table.append(blank, commit, order, finish=lambda new: new.withColumn("embedding", embed(F.col(text)).cast(VECTOR.dataType)))


def add_pairs(table: KeyedTable, pairs: DataFrame, embed: Embed = hash_embed, commit: str | None = None, by_id: bool = False) -> Appended:
    """Add pairs (pair_id, nlq, sql) whose question and SQL are new, their questions embedded; of
    equal ones the smallest id. ``by_id``: equal pairs under different ids all count."""
    key = F.md5(F.concat_ws("\u001f", F.col("pair_id").cast("string"), content_key())) if by_id else content_key()
    return _with_vector(table, "nlq", embed, pairs.withColumn(KEY, key), commit, "pair_id")


def add_lessons(table: KeyedTable, lessons: DataFrame, embed: Embed = hash_embed, commit: str | None = None) -> Appended:
    """Add lessons (lesson_id, the six fields) that are new, their triggers embedded."""
    return _with_vector(table, "trigger", embed, lessons.withColumn(KEY, lesson_key()), commit, "lesson_id")
