"""Queries over the record tables: metrics, split, corpus maintenance, integrity, run state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sqltext as st
from tessera.functions.embed import hash_embed_sparse
from tessera.operators import metrics as mt
from tessera.operators.similarity import mean_score, similarity_topk
from tessera.operators.split import leakage_report, train_eval_split
from tessera.plans import bindings, retrieval
from tessera.session import spread
from tessera.sources.tables import table

CONFIDENCE_THRESHOLD = 0.75


def _round_metrics(m: DataFrame) -> DataFrame:
    for c in ("overall_pass_rate", "kb_recovery_rate", "lesson_utilization", "avg_sim1",
              "avg_sim2", "avg_latency_ms"):
        m = m.withColumn(c, F.round(c, 6))
    return m


def q_eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _round_metrics(mt.eval_metrics(bindings.eval_items(spark, d), by=[]))


def q_eval_metrics_by_run(spark: SparkSession, d: str) -> DataFrame:
    return _round_metrics(mt.eval_metrics(bindings.eval_items(spark, d), by="run_id"))


def q_metrics_report(spark: SparkSession, d: str) -> DataFrame:
    m = mt.eval_metrics(bindings.eval_items(spark, d), by="run_id")
    return m.select("run_id", mt.format_report(m).alias("report"))


def q_metrics_json(spark: SparkSession, d: str) -> DataFrame:
    m = _round_metrics(mt.eval_metrics(bindings.eval_items(spark, d), by="run_id"))
    return m.select("run_id", mt.metrics_json(m).alias("metrics"))


def q_train_eval_split(spark: SparkSession, d: str) -> DataFrame:
    return train_eval_split(bindings.pairs(spark, d), "pair_id").select("pair_id", "split")


def q_split_leakage_check(spark: SparkSession, d: str) -> DataFrame:
    return leakage_report(train_eval_split(bindings.pairs(spark, d), "pair_id"))


def q_backfill_union(spark: SparkSession, d: str) -> DataFrame:
    """After evaluation, the held-out pairs join the example corpus."""
    s = train_eval_split(bindings.pairs(spark, d), "pair_id")
    train = s.filter(F.col("split") == "train").drop("split").withColumn("origin", F.lit("train"))
    ev = s.filter(F.col("split") == "eval").drop("split").withColumn("origin", F.lit("backfill"))
    return train.unionByName(ev)


def q_kb_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Set the vector id of pair records: left join on the key, new value over old."""
    base = bindings.pairs(spark, d).select("pair_id", F.lit(None).cast("long").alias("vec_id"))
    upd = table(spark, d, "embeddings").select(F.col("vec_id").alias("pair_id"),
                                               F.col("vec_id").alias("new_vec_id"))
    return (base.join(upd, "pair_id", "left")
            .select("pair_id", F.coalesce("new_vec_id", "vec_id").alias("vec_id")))


def content_key(nlq: str = "nlq", sql: str = "sql"):
    return F.md5(F.concat_ws("\u001f", F.col(nlq), F.col(sql)))


def append_by_content(existing: DataFrame, batch: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """Idempotent append: batch rows whose content key is new (one per key, smallest id)."""
    ek = existing.select(content_key().alias("_k"))
    fresh = (batch.withColumn("_k", content_key())
             .groupBy("_k").agg(F.min(id_col).alias(id_col))
             .join(ek, "_k", "left_anti"))
    return fresh.drop("_k")


def q_kb_append(spark: SparkSession, d: str) -> DataFrame:
    p = bindings.pairs(spark, d).join(
        table(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"), "o_orderstatus",
                                         "o_orderpriority"), "pair_id")
    existing = p.filter(F.col("o_orderstatus") == "F")
    batch = p.filter(F.col("o_orderpriority") == "1-URGENT")
    added = append_by_content(existing, batch)
    return (existing.select("pair_id", F.lit("existing").alias("origin"))
            .unionByName(added.select("pair_id", F.lit("appended").alias("origin"))))


def lessons_table(spark: SparkSession, d: str) -> DataFrame:
    """Lessons that parsed, keyed by the id of the item they came from."""
    lt = st.with_parsed_lesson(bindings.lesson_texts(spark, d), "text", "p")
    return lt.filter("p_ok").select(F.col("id").alias("lesson_id"),
                                    *[F.col(f"p_{f}").alias(f) for f in st.LESSON_FIELDS])


def run_events(spark: SparkSession, d: str) -> DataFrame:
    """Append-only run state events: run = user, status from the event kind."""
    e = table(spark, d, "events")
    status = (F.when(F.col("event_type") == "error", F.lit("failed"))
              .when(F.col("event_type") == "purchase", F.lit("done")).otherwise(F.lit("running")))
    return e.select(F.col("user_id").alias("run_id"), status.alias("status"),
                    F.col("ts").alias("event_time"), "event_id")


def q_run_status_latest(spark: SparkSession, d: str) -> DataFrame:
    ev = run_events(spark, d)
    last = ev.groupBy("run_id").agg(
        F.max_by(F.struct("status", "event_time"), F.struct("event_time", "event_id")).alias("s"))
    return last.select("run_id", F.col("s.status").alias("status"), F.col("s.event_time").alias("updated_at"))


def q_fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation results whose lesson or run reference has no row."""
    items = bindings.eval_items(spark, d).select(
        F.col("item_id").alias("result_id"), "run_id",
        F.when(F.col("retried"), F.col("item_id")).alias("used_lesson_id"))
    lessons = lessons_table(spark, d).select(F.col("lesson_id").alias("used_lesson_id"))
    runs = run_events(spark, d).select("run_id").distinct()
    bad_lesson = (items.filter(F.col("used_lesson_id").isNotNull())
                  .join(lessons, "used_lesson_id", "left_anti")
                  .select("result_id", F.lit("lesson").alias("ref_kind"), F.col("used_lesson_id").alias("ref_id")))
    # The few run ids without a row, found on distinct ids, so no task holds one run's items.
    no_run = items.select("run_id").distinct().join(runs, "run_id", "left_anti")
    bad_run = (items.join(no_run, "run_id")
               .select("result_id", F.lit("run").alias("ref_kind"), F.col("run_id").alias("ref_id")))
    return bad_lesson.unionByName(bad_run)


def q_retry_gate(spark: SparkSession, d: str) -> DataFrame:
    """Retry when the retrieval confidence is below the threshold (strict) or the first
    attempt is not valid SQL."""
    v = bindings.question_items(spark, d).select("id", "embedding").checkpoint(eager=True)
    hits = similarity_topk(v, v, retrieval.EXAMPLES_K, query_id="id", corpus_id="id", exclude_self=True)
    conf = mean_score(hits, v, "id", "confidence")
    first = st.with_validation(bindings.sql_texts(spark, d), "sql", "v").select(
        F.col("id").alias("query_id"), F.col("v_valid").alias("valid"))
    return (conf.join(first, "query_id")
            .select("query_id", F.round("confidence", 6).alias("confidence"), "valid",
                    ((F.col("confidence") < CONFIDENCE_THRESHOLD) | ~F.col("valid")).alias("retry")))


def q_hash_embed(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents"))
    return hash_embed_sparse(docs, "doc_id", "text").withColumn("weight", F.round("weight", 6))


def add_examples(corpus: DataFrame, batch: DataFrame, embed=None) -> DataFrame:
    """Add pairs to the example corpus: embed the question of the rows whose content key is
    new and append them (``corpus``: ``pair_id, nlq, sql, embedding``)."""
    from tessera.functions.embed import hash_embed
    embed = embed or hash_embed
    fresh = append_by_content(corpus, batch).select("pair_id")
    new = batch.join(fresh, "pair_id", "left_semi").withColumn("embedding", embed(F.col("nlq")))
    return corpus.unionByName(new.select(*corpus.columns))


def add_lessons(corpus: DataFrame, lessons: DataFrame, embed=None) -> DataFrame:
    """Add lessons to the lesson corpus, embedding the trigger text (not the title)."""
    from tessera.functions.embed import hash_embed
    embed = embed or hash_embed
    new = lessons.join(corpus.select("lesson_id"), "lesson_id", "left_anti") \
        .withColumn("embedding", embed(F.col("trigger")))
    return corpus.unionByName(new.select(*corpus.columns))
