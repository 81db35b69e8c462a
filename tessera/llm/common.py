"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.session import removed, saved, together  # noqa: F401

#: Bytes of text that a task turns into Python objects at a time (at least one row), so its
#: memory does not follow the size of an Arrow batch.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame, once its session hands rows to Python in batches of at most
    ``SLICE_BYTES``: a batch counts in the JVM and in Python, in and out, for every core."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(key).rstrip("bB")) <= SLICE_BYTES:
        conf.set(key, str(SLICE_BYTES))
    return df


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``size`` bytes (or elements) in the column number ``text``; empty ones
    go."""
    for batch in batches:
        col = batch.column(text)
        sizes = pc.list_value_length(col) if pa.types.is_list(col.type) else pc.binary_length(col)
        ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def known(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast: ``known(docs, doc_id="long", text="string")``. Further
    columns of the input, whatever they are called, never meet the operator's own."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def broadcastable(df: DataFrame, max_rows: int) -> bool:
    """Whether a saved frame has at most ``max_rows`` rows; beyond, callers take another way."""
    return df.count() <= max_rows


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """Tells rows apart by id and text. Rows equal in both get the same results."""
    return F.struct(F.coalesce(F.col(doc_id), F.lit(-(1 << 63))).alias("d"),
                    F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"))
