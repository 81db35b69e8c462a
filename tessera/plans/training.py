"""The training cycle: ingest -> fill -> split -> evaluate -> backfill -> metrics -> run record.

The held-out items are evaluated against the training examples only; inside the run an
item sees lessons of the items evaluated before it, in the order of the seeded shuffle
(the as-of key is the seeded hash, then the id). After the evaluation the held-out pairs
join the example corpus (backfill). The run is recorded as append-only state events:
``running`` when it starts, ``done`` with the metrics as JSON when it ends, or ``failed``
with ``{"error": ...}`` when a stage raises.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.embed import hash_embed
from tessera.operators.metrics import METRIC_COLUMNS, eval_metrics
from tessera.operators.split import seeded_hash, train_eval_split
from tessera.plans import bindings, ingest, workflow

RUN_EVENT_SCHEMA = "run_id long, status string, metrics string, event_time timestamp"


def run_event(spark: SparkSession, run_id: int, status: str, metrics: str | None = None) -> DataFrame:
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return spark.createDataFrame([(run_id, status, metrics, now)], RUN_EVENT_SCHEMA)


def cycle_items(spark: SparkSession, d: str, seed: int = 42) -> DataFrame:
    """Ingested, filled pairs, each question embedded, with the as-of key of the shuffle order."""
    pairs = ingest.fill_missing_nlq(ingest.ingest(spark, d).checkpoint(eager=True),
                                    bindings.recorded_responses(spark, d))
    h = seeded_hash("pair_id", seed)
    return pairs.select(F.col("pair_id").alias("id"), hash_embed("nlq").alias("embedding"),
                        F.conv(F.substring(h, 1, 15), 16, 10).cast("long").alias("run_id"),
                        F.col("pair_id").alias("ordinal"), "nlq", F.col("sql").alias("gold_sql"),
                        F.col("pair_id"))


def training_cycle(spark: SparkSession, d: str, run_id: int = 1, events: list | None = None) -> DataFrame:
    """Run one cycle; returns one row with run status, corpus sizes and the ten metrics."""
    events = events if events is not None else []
    events.append(run_event(spark, run_id, "running"))
    try:
        items = cycle_items(spark, d).checkpoint(eager=True)
        split = train_eval_split(items, "pair_id")
        train = split.filter(F.col("split") == "train")
        held = split.filter(F.col("split") == "eval").drop("split", "pair_id")
        corpus = train.select("id", "embedding", "nlq", F.col("gold_sql").alias("sql"))
        ev = workflow.eval_attempts(spark, d, items=held, corpus=corpus, lesson_embed=hash_embed)
        examples = corpus.unionByName(held.select("id", "embedding", "nlq", F.col("gold_sql").alias("sql")))
        m = eval_metrics(ev.withColumn("run_id", F.lit(run_id).cast("long")), by="run_id")
        sizes = split.agg(F.count_if(F.col("split") == "train").cast("long").alias("n_train"),
                          F.count_if(F.col("split") == "eval").cast("long").alias("n_eval"))
        n_examples = examples.agg(F.count(F.lit(1)).alias("n_examples_after_backfill"))
        out = (m.join(sizes.withColumn("run_id", F.lit(run_id).cast("long")), "run_id")
               .join(n_examples.withColumn("run_id", F.lit(run_id).cast("long")), "run_id"))
        out = out.checkpoint(eager=True)
        metrics_json = out.select(F.to_json(F.struct(*METRIC_COLUMNS)).alias("j")).first()["j"]
        events.append(run_event(spark, run_id, "done", metrics_json))
        return out.select("run_id", F.lit("done").alias("status"), "n_train", "n_eval",
                          "n_examples_after_backfill", *METRIC_COLUMNS)
    except Exception as e:
        events.append(run_event(spark, run_id, "failed", json.dumps({"error": str(e)})))
        raise


def latest_status(events: DataFrame) -> DataFrame:
    """Current state of every run: the latest event."""
    return (events.groupBy("run_id")
            .agg(F.max_by(F.struct("status", "metrics", "event_time"),
                          F.struct("event_time", (F.col("status") != "running").alias("terminal"))).alias("s"))
            .select("run_id", "s.status", "s.metrics", F.col("s.event_time").alias("updated_at")))


def q_training_cycle_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = training_cycle(spark, d)
    for c in ("overall_pass_rate", "kb_recovery_rate", "lesson_utilization", "avg_sim1", "avg_sim2",
              "avg_latency_ms"):
        out = out.withColumn(c, F.round(c, 6))
    return out
