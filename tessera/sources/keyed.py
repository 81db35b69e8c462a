"""Tables addressed by a content key: idempotent appends that read only what they must.

Rows lie in buckets by the first hex digits of their key (an md5). Each commit writes its rows, a
Bloom filter per bucket it adds to, and last a marker; rows without a marker are never read, and a
commit that was cut off is written over when it is repeated under its name. An append asks the
filters of the buckets that its batch touches; rows no filter knows are new without reading any
stored row, and only buckets in which some filter says "maybe" are read, their key column alone.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "content_key"
_COMMITS = "commit string, replaces array<string>, n_offered long, n_added long, buckets_touched int, buckets_read int"
_BLOOMS = "bucket string, n long, bits binary"
BITS_PER_KEY, HASHES = 20, 12


def _places(keys: list[str], bits: int) -> np.ndarray:
    """The places of each key (hex digits) in a filter of so many bits."""
    words = np.array([(int(k[:16], 16), int(k[16:32], 16) | 1) for k in keys], np.uint64).reshape(-1, 2)
    return (words[:, :1] + words[:, 1:] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


def bloom(keys: list[str]) -> bytes:
    bits = -(-max(len(keys), 1) * BITS_PER_KEY // 8) * 8
    out = np.zeros(bits, np.uint8)
    out[_places(keys, bits).ravel()] = 1
    return np.packbits(out).tobytes()


def may_hold(filter_: bytes, keys: list[str]) -> np.ndarray:
    if not keys:
        return np.zeros(0, bool)
    out = np.unpackbits(np.frombuffer(filter_, np.uint8))
    return out[_places(keys, len(out))].all(1)


@dataclass(frozen=True)
class Appended:
    """What an append did. ``rows``: those that were new."""

    commit: str
    n_offered: int
    n_added: int
    buckets_touched: int
    buckets_read: int
    rows: DataFrame


class KeyedTable:
    """A table at ``path`` with the columns of ``schema`` and ``content_key``. ``digits``: hex digits
    of the key that name a bucket; a bucket's keys of one batch, and its filters, should fit a task."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, digits: int = 2):
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits
        self.schema = T.StructType([*[f for f in schema.fields if f.name != KEY], T.StructField(KEY, T.StringType())])

    def _read(self, schema, paths: list[str], base: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return (reader.option("basePath", base) if base else reader).parquet(*paths)

    def commits(self) -> DataFrame:
        """One row per commit that was completed."""
        try:
            found = self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits")
            found.limit(1).collect()  # an empty folder is told only when read
            return found
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _COMMITS)

    def _live(self) -> list[str]:
        """Commits whose rows count: a row per commit, not one of the table, comes to the driver."""
        rows = self.commits().select("commit", "replaces").collect()
        gone = {c for r in rows for c in r.replaces}
        return sorted({r.commit for r in rows} - gone)

    def rows(self, buckets: list[str] | None = None) -> DataFrame:
        """The stored rows, of these buckets only if they are given."""
        with_bucket = T.StructType([*self.schema.fields, T.StructField("commit", T.StringType()), T.StructField("bucket", T.StringType())])
        df = self._read(with_bucket, [f"{self.path}/data/commit={c}" for c in self._live()], f"{self.path}/data")
        if buckets is not None:
            df = df.where(F.col("bucket").isin(buckets)) if buckets else df.where("false")
        return df.select(*self.schema.names)

    def _bucket(self):
        return F.substring(KEY, 1, self.digits)

    def _maybe(self, keys: DataFrame, live: list[str]) -> DataFrame:
        """(bucket) of the keys that some filter knows."""
        blooms = self._read(_BLOOMS, [f"{self.path}/blooms/commit={c}" for c in live])
        schema = "bucket string"

        def run(key, mine, filters):
            hashed = mine.column(KEY).to_pylist()
            maybe = np.zeros(len(hashed), bool)
            for f in filters.column("bits").to_pylist():
                maybe |= may_hold(f, hashed)
            return pa.table({"bucket": pa.array([key[0].as_py()] if maybe.any() else [], pa.string())})

        return keys.groupBy("bucket").cogroup(blooms.groupBy("bucket")).applyInArrow(run, schema)

    def new(self, batch: DataFrame, order: str | None = None) -> tuple[DataFrame, list[str], list[str]]:
        """The batch's rows whose key is not stored, one per key (the first by ``order``), and the
        buckets that the batch touches and that had to be read."""
        rest = [c for c in self.schema.names if c != KEY]
        first = F.struct(*([order] if order else []), *[c for c in rest if c != order])
        one = batch.select(*self.schema.names).groupBy(KEY).agg(F.min(first).alias("r")) \
            .select(*[F.col(f"r.`{c}`").alias(c) for c in rest], KEY).checkpoint(eager=True)
        keys = one.select(KEY, self._bucket().alias("bucket"))
        touched = sorted(r.bucket for r in keys.select("bucket").distinct().collect())  # 16 to the digits at most
        live = self._live()
        read = sorted(r.bucket for r in self._maybe(keys, live).collect()) if live else []
        if read:
            one = one.join(self.rows(read).select(KEY), KEY, "left_anti").select(*self.schema.names)
        return one, touched, read

    def append(self, batch: DataFrame, commit: str | None = None, order: str | None = None, finish=None) -> Appended:
        """Add the rows whose key is new. Under the name of a completed commit nothing is done again.
        ``finish`` turns the new rows into those that are stored (it may fill columns that the batch
        has as null), so that work on rows that are known already is not done."""
        commit = commit or uuid.uuid4().hex
        done = self.commits().where(F.col("commit") == commit).first()
        if done is not None:
            return Appended(commit, done.n_offered, 0, 0, 0, self.rows([]))
        fresh, touched, read = self.new(batch, order)
        fresh = (finish(fresh).select(*self.schema.names) if finish else fresh).checkpoint(eager=True)
        sizes = (batch.count(), fresh.count(), len(touched), len(read))
        self._write(fresh, commit, [], sizes)
        return Appended(commit, *sizes, fresh)

    def _write(self, rows: DataFrame, commit: str, replaces: list[str], sizes: tuple[int, int, int, int]) -> None:
        rows = rows.withColumn("bucket", self._bucket())

        def run(key, mine):
            keys = mine.column(KEY).to_pylist()
            return pa.table({"bucket": [key[0].as_py()], "n": [len(keys)], "bits": pa.array([bloom(keys)], pa.binary())})

        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/commit={commit}")
        rows.select(KEY, "bucket").groupBy("bucket").applyInArrow(run, _BLOOMS).write.mode("overwrite").parquet(f"{self.path}/blooms/commit={commit}")
        # The marker, one row in one file: from here on the commit counts.
        self.spark.createDataFrame([(commit, replaces, *sizes)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def compact(self) -> str:
        """Put the rows of all commits under one, so that a reader opens fewer files."""
        live, commit = self._live(), uuid.uuid4().hex
        rows = self.rows()
        self._write(rows, commit, live, (0, 0, 0, 0))
        return commit
