"""Writing and reading the record tables and vector corpora (parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_eval_results(df: DataFrame, path: str) -> None:
    """Append evaluation results, partitioned by run so a run's rows are pruned by path."""
    df.write.mode("append").partitionBy("training_run_id").parquet(path)


def save_corpus(df: DataFrame, path: str) -> None:
    """Save a vector corpus (vectors and payload in one table)."""
    df.write.mode("overwrite").parquet(path)


def load_corpus(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Load a saved corpus; a missing path gives an empty corpus of the given schema."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise
