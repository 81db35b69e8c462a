"""Session helpers: building a session for tests/bench and finding the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of ours wants. Shuffle partitions are sized by the caller;
# AQE coalesces small partitions and splits skewed ones at runtime.
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the benchmark. On a cluster, use the cluster's session."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the cluster and is read from the session. Only when
    it is unset and the master is local (tests) do we create one of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written stage output."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df, name: str):
    """Write ``df`` below the shared checkpoint folder and read it back: cuts the lineage
    and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def saved_alone(df, name: str):
    """``saved``, and what was shuffled for it goes at once."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return saved(df, name)
    finally:
        conf.set(key, before)


def together(frames: list):
    """Saved frames of one schema as one."""
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*[f._saved_at for f in frames])


def removed(*frames) -> None:
    """The files of saved frames go: of frames that nothing reads any more."""
    for f in frames:
        jvm, conf = f.sparkSession._jvm, f.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f._saved_at)
        path.getFileSystem(conf).delete(path, True)


def spread(df, min_partitions: int | None = None):
    """Round-robin repartition when a frame has fewer partitions than the session has cores.

    For CPU-heavy per-row work (regexes over text, vector scoring) on an input that arrives
    in few partitions (one big file, one row group). On a cluster reading many files the
    input is already wide and this is a no-op, so no shuffle is added there.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
