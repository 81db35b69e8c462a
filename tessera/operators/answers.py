"""Live model calls behind a store of answers.

An answer is addressed by the hash of its prompt. Prompts that the store knows are never sent
again; the others are sent once each, with retries and growing pauses, and their answers are
committed to the store before anything uses them. So a stage that is run again, by Spark or by the
user, asks only what is still open. Failed calls are not stored: a later run asks them again.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.model import _finish, prompt_md5
from tessera.sources.keyed import KEY, KeyedTable

ANSWERS = T.StructType([T.StructField("text", T.StringType()), T.StructField("elapsed_ms", T.DoubleType())])
_CALLED = f"{KEY} string, text string, error string, elapsed_ms double"

ModelFactory = Callable[[], Callable[[str, str, float], str]]


class AnswerStore:
    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        self.table = KeyedTable(spark, path, ANSWERS, digits)

    def ask(self, requests: DataFrame, fn_factory: ModelFactory, concurrency: int | None = None,
            attempts: int = 3, pause: float = 0.5) -> DataFrame:
        """The requests (key columns, system, human, temperature) with text, error, elapsed_ms, and
        whether the answer was stored before (``reused``). A null answer is an error."""
        concurrency = concurrency or requests.sparkSession.sparkContext.defaultParallelism
        keyed = requests.withColumn(KEY, prompt_md5()).checkpoint(eager=True)
        prompts = keyed.groupBy(KEY).agg(*[F.first(c).alias(c) for c in ("system", "human", "temperature")])
        known = self._answers(keyed).select(KEY)
        open_ = prompts.join(known, KEY, "left_anti").repartition(concurrency, KEY)

        def run(batches):
            fn = fn_factory()
            for pdf in batches:
                out = [_call(fn, s, h, float(t), attempts, pause) for s, h, t in zip(pdf["system"], pdf["human"], pdf["temperature"])]
                text, error, ms = zip(*out) if out else ((), (), ())
                yield pd.DataFrame({KEY: pdf[KEY], "text": list(text), "error": list(error), "elapsed_ms": list(ms)})

        called = open_.mapInPandas(run, _CALLED).checkpoint(eager=True)
        self.table.append(called.where("error is null and text is not null").select(KEY, "text", "elapsed_ms"))
        fresh = called.withColumn("reused", F.lit(False))
        stored = self._answers(keyed).join(called.select(KEY), KEY, "left_anti") \
            .select(KEY, "text", F.lit(None).cast("string").alias("error"), "elapsed_ms", F.lit(True).alias("reused"))
        return _finish(keyed.join(fresh.unionByName(stored), KEY, "left").drop(KEY))

    def _answers(self, keyed: DataFrame) -> DataFrame:
        """Stored answers of the buckets that these prompts touch."""
        touched = keyed.select(F.substring(KEY, 1, self.table.digits).alias("b")).distinct().collect()
        return self.table.rows([r.b for r in touched]).join(keyed.select(KEY).distinct(), KEY, "left_semi")


def _call(fn, system: str, human: str, temperature: float, attempts: int, pause: float):
    start = time.perf_counter()
    text = error = None
    for k in range(attempts):
        if k:
            time.sleep(pause * 2 ** (k - 1))
        try:
            text, error = fn(system, human, temperature), None
            break
        except Exception as e:  # noqa: BLE001 - any model failure becomes an error row
            error = f"{type(e).__name__}: {e}"
    return text, error, (time.perf_counter() - start) * 1000.0


class StoredModel:
    """A model and the store that its answers go through."""

    def __init__(self, store: AnswerStore, fn_factory: ModelFactory, **options):
        self.store, self.fn_factory, self.options = store, fn_factory, options

    def ask(self, requests: DataFrame) -> DataFrame:
        return self.store.ask(requests, self.fn_factory, **self.options)
