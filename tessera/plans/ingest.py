"""Ingest queries: pair CSV files written from the input tables and read back by the
batch reader or the file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import prompts as pr
from tessera.functions.embed import DEFAULT_DIM
from tessera.functions.sqltext import LESSON_FIELDS
from tessera.operators import model
from tessera.plans import bindings
from tessera.session import scratch_path
from tessera.sources import pairs as src
from tessera.sources.corpus import add_pairs, examples_table, lessons_table
from tessera.sources.tables import table
from tessera.streaming.ingest import stream_ingest, stream_lessons

#: Files that the stream queries write their input to.
STREAM_FILES = 8
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("pair_id", "nlq", "sql", "note")])


def ingest(spark: SparkSession, d: str, files: int | None = None) -> DataFrame:
    path = scratch_path(spark, "pairs-csv")
    src.write_pairs_csv(bindings.pair_csv_rows(spark, d), path, files)
    return src.read_pairs_csv(spark, path)


def fill_missing_nlq(pairs: DataFrame, responses) -> DataFrame:
    """Rows without a question get one from the model; a row whose call fails is dropped.
    Rows that have a question never reach the model."""
    return filled_and_dropped(pairs, responses)[0]


def filled_and_dropped(pairs: DataFrame, responses) -> tuple[DataFrame, DataFrame]:
    """The filled pairs, and the rows (pair_id, sql, error) that went because their call failed.
    ``responses``: a recorded table, or a ``StoredModel``."""
    have = pairs.filter(F.col("nlq") != "")
    need = pairs.filter(F.col("nlq") == "").withColumn("id", F.col("pair_id"))
    req = (need.withColumn("call", F.lit("nlq")).withColumn("system", F.lit(pr.NLQ_GEN_SYSTEM))
           .withColumn("human", pr.nlq_gen_human("sql")).withColumn("temperature", F.lit(0.0)))
    got = model.recorded(req, responses, ["id", "call"]) if isinstance(responses, DataFrame) else responses.ask(req)
    filled = got.filter(F.col("error").isNull()).select("pair_id", F.col("text").alias("nlq"), "sql")
    return have.select("pair_id", "nlq", "sql").unionByName(filled), got.filter(F.col("error").isNotNull()).select("pair_id", "sql", "error")


def q_ingest_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ingest(spark, d)


def q_fill_missing_nlq(spark: SparkSession, d: str) -> DataFrame:
    p = ingest(spark, d).checkpoint(eager=True)
    return fill_missing_nlq(p, bindings.recorded_responses(spark, d))


def q_stream_ingest_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Stream the CSV files into a pair table in several micro-batches, twice; the second run adds
    nothing."""
    source = scratch_path(spark, "pairs-stream-src")
    src.write_pairs_csv(bindings.pair_csv_rows(spark, d), source, STREAM_FILES)
    path = scratch_path(spark, "pairs-table")
    stream_ingest(spark, source, path, scratch_path(spark, "pairs-stream-ckpt"), RAW_SCHEMA, files_per_batch=3, digits=1)
    return stream_ingest(spark, source, path, scratch_path(spark, "pairs-stream-ckpt2"), RAW_SCHEMA, digits=1).rows().select("nlq", "sql")


def q_stream_lessons(spark: SparkSession, d: str) -> DataFrame:
    """Stream lesson files into a table of lessons, and again by another checkpoint."""
    source, path = scratch_path(spark, "lessons-stream-src"), scratch_path(spark, "lessons-table")
    bindings.lesson_texts(spark, d).repartition(STREAM_FILES, "id").write.json(source)
    lessons = lessons_table(spark, path, digits=1)
    stream_lessons(spark, source, lessons, scratch_path(spark, "lessons-ckpt"), files_per_batch=3)
    stream_lessons(spark, source, lessons, scratch_path(spark, "lessons-ckpt2"))
    return lessons.rows().select("lesson_id", *LESSON_FIELDS)


def q_kb_append_stored(spark: SparkSession, d: str) -> DataFrame:
    """Three appends to a stored corpus of examples: what is there, a batch that overlaps it, and the
    batch again; with what each offered, added and had to read."""
    p = bindings.pairs(spark, d).join(table(spark, d, "orders").select(
        F.col("o_orderkey").alias("pair_id"), "o_orderstatus", "o_orderpriority"), "pair_id")
    corpus = examples_table(spark, scratch_path(spark, "examples"))
    batch = p.filter(F.col("o_orderpriority") == "1-URGENT")
    rows, n = [], 0
    for step, some in enumerate([p.filter(F.col("o_orderstatus") == "F"), batch, batch]):
        a = add_pairs(corpus, some)
        n += a.n_added
        rows.append((step + 1, a.n_offered, a.n_added, n, a.buckets_touched, a.buckets_read))
    told = spark.createDataFrame(rows, "step int, n_offered long, n_added long, n_after long, buckets_touched int, buckets_read int")
    stored = corpus.rows().agg(F.count("*").alias("n_stored"), F.count_if(F.size("embedding") == DEFAULT_DIM).alias("n_embedded"))
    return told.crossJoin(F.broadcast(stored))
