"""Stored training runs: a cycle over a user's pairs that can be cut off and taken up again.

``RunLog`` is a folder of stage tables and an append-only table of events. A stage is written whole and
then marked by an event; a run that is started again reads the stages that are marked and goes on with
the first that is not. Corpora of examples and lessons are stored between runs; a run's appends are
commits under its own name, so taking it up again adds nothing twice.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.embed import hash_embed
from tessera.functions.sqltext import LESSON_FIELDS
from tessera.operators.metrics import METRIC_COLUMNS, eval_metrics
from tessera.operators.split import seeded_hash, train_eval_split
from tessera.plans import bindings, ingest, workflow
from tessera.session import scratch_path
from tessera.sources.corpus import add_lessons, add_pairs, examples_table, lessons_table

EVENTS = "run_id long, status string, stage string, detail string, event_time timestamp"
RUNNING, STAGE, DONE, FAILED = "running", "stage", "done", "failed"


class RunLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def event(self, run_id: int, status: str, stage: str | None = None, detail: str | None = None) -> None:
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        self.spark.createDataFrame([(run_id, status, stage, detail, now)], EVENTS).coalesce(1).write.mode("append").parquet(f"{self.path}/events")

    def events(self) -> DataFrame:
        try:
            found = self.spark.read.schema(EVENTS).parquet(f"{self.path}/events")
            found.limit(1).collect()
            return found
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], EVENTS)

    def status(self) -> DataFrame:
        """(run_id, status, detail, updated_at): the last event of each run that is no stage's."""
        last = F.max_by(F.struct("status", "detail", "event_time"), F.struct("event_time", (F.col("status") != RUNNING).alias("ended")))
        return self.events().where(F.col("status") != STAGE).groupBy("run_id").agg(last.alias("e")) \
            .select("run_id", "e.status", "e.detail", F.col("e.event_time").alias("updated_at"))

    def has(self, run_id: int, stage: str) -> bool:
        return not self.events().where((F.col("run_id") == run_id) & (F.col("stage") == stage)).isEmpty()

    def _folder(self, run_id: int, stage: str) -> str:
        return f"{self.path}/{stage}/run={run_id}"

    def stage(self, run_id: int, stage: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of a run's stage: as stored if it was completed, else built, written and marked."""
        if not self.has(run_id, stage):
            build().write.mode("overwrite").parquet(self._folder(run_id, stage))
            self.event(run_id, STAGE, stage)
        return self.spark.read.parquet(self._folder(run_id, stage))

    def table(self, stage: str) -> DataFrame:
        """A stage's rows of all runs that completed it, with the column ``run``."""
        runs = [r.run_id for r in self.events().where(F.col("stage") == stage).select("run_id").distinct().collect()]
        return self.spark.read.option("basePath", f"{self.path}/{stage}").parquet(*[self._folder(r, stage) for r in runs])


def run_cycle(spark: SparkSession, pairs: DataFrame, path: str, run_id: int, responses, embed=hash_embed,
              eval_fraction: float = 0.2, seed: int = 42, digits: int = 2) -> DataFrame:
    """One training cycle over pairs (pair_id, nlq, sql; ids unique): the row of its metrics.

    fill missing questions; split; add the training pairs to the stored examples; evaluate the others
    against all stored examples, with the lessons of earlier runs and of items before; store results
    and lessons; add the evaluated pairs to the examples; metrics. ``responses``: recorded answers
    (id, call, text, error, elapsed_ms), a model factory, or a ``StoredModel``. Called again under its
    ``run_id`` after a failure, it goes on where it ended; after success it reads what is stored.
    """
    log = RunLog(spark, f"{path}/runs")
    examples = examples_table(spark, f"{path}/examples", digits)
    lessons = lessons_table(spark, f"{path}/lessons", digits)
    if not log.has(run_id, "metrics"):
        log.event(run_id, RUNNING)
    try:
        dropped = {}

        def fill():
            filled, dropped["rows"] = ingest.filled_and_dropped(pairs.checkpoint(eager=True), responses)
            return filled

        filled = log.stage(run_id, "pairs", fill)
        if filled.isEmpty():
            raise ValueError("No valid rows remain after NLQ generation.")
        if "rows" in dropped:
            log.stage(run_id, "dropped", lambda: dropped["rows"])
        split = log.stage(run_id, "split", lambda: train_eval_split(filled, "pair_id", eval_fraction, seed))
        add_pairs(examples, split.where("split = 'train'"), embed, f"run-{run_id}-train", by_id=True)

        h = seeded_hash("pair_id", seed)
        held = split.where("split = 'eval'").select(
            F.col("pair_id").alias("id"), embed(F.col("nlq")).alias("embedding"), F.conv(F.substring(h, 1, 15), 16, 10).cast("long").alias("run_id"),
            F.col("pair_id").alias("ordinal"), "nlq", F.col("sql").alias("gold_sql"))
        learned = {}

        def evaluate():
            items = held.checkpoint(eager=True)
            corpus = examples.rows().select(F.col("pair_id").alias("id"), "embedding", "nlq", "sql").checkpoint(eager=True)
            given = {"responses": responses} if isinstance(responses, DataFrame) else {"model_factory": responses}
            stored = lessons.rows().select("lesson_id", "embedding", *LESSON_FIELDS)
            out = workflow.eval_attempts(spark, "", items=items, corpus=corpus, lesson_embed=embed, earlier_lessons=stored, keep=learned, **given)
            # Lessons first: once the results are marked, this is not called again.
            learned["lessons"].select("lesson_id", *LESSON_FIELDS).write.mode("overwrite").parquet(log._folder(run_id, "lessons"))
            return out.join(items.select(F.col("id").alias("item_id"), "nlq", "gold_sql"), "item_id")

        results = log.stage(run_id, "results", evaluate)
        new = spark.read.parquet(log._folder(run_id, "lessons"))
        add_lessons(lessons, new, embed, f"run-{run_id}")
        add_pairs(examples, split.where("split = 'eval'"), embed, f"run-{run_id}-eval", by_id=True)

        def metrics():
            m = eval_metrics(results.withColumn("run_id", F.lit(run_id).cast("long")), by="run_id")
            sizes = split.agg(F.count_if(F.col("split") == "train").cast("long").alias("n_train"), F.count_if(F.col("split") == "eval").cast("long").alias("n_eval"))
            n = examples.rows().agg(F.count(F.lit(1)).alias("n_examples_after_backfill"))
            return m.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(n))

        out = log.stage(run_id, "metrics", metrics)
        if log.status().where((F.col("run_id") == run_id) & (F.col("status") == DONE)).isEmpty():
            log.event(run_id, DONE, detail=out.select(F.to_json(F.struct(*METRIC_COLUMNS)).alias("j")).first()["j"])
        return out.select("run_id", F.lit(DONE).alias("status"), "n_train", "n_eval", "n_examples_after_backfill", *METRIC_COLUMNS)
    except Exception as e:
        log.event(run_id, FAILED, detail=json.dumps({"error": str(e)}))
        raise


def q_training_run_stored(spark: SparkSession, d: str) -> DataFrame:
    """A stored run over the pair files, read back from its tables."""
    path = scratch_path(spark, "training")
    out = run_cycle(spark, ingest.ingest(spark, d), path, 1, bindings.recorded_responses(spark, d), digits=1)
    for c in ("overall_pass_rate", "kb_recovery_rate", "lesson_utilization", "avg_sim1", "avg_sim2", "avg_latency_ms"):
        out = out.withColumn(c, F.round(c, 6))
    return out
