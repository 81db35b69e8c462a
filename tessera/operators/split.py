"""Seeded train/evaluation split without a global sort.

Rule: order the rows by a seeded hash, the first ``cut`` rows are training rows, where
``cut = min(max(1, int(n * (1 - eval_fraction))), n - 1)``; fewer than two rows is an
error. Repeatable for a given seed, disjoint, sizes exact.

Plan: an unpartitioned ``row_number`` would send every row to one task. Instead rows are
put in buckets by the leading hex digits of their hash; one small aggregate counts the
buckets (at most 16**digits rows reach the driver); only the bucket holding the cut is
ordered, to find the cut. Every row is then decided by a comparison with the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seeded_hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def cut_index(n: int, eval_fraction: float = 0.2) -> int:
    if n < 2:
        raise ValueError(f"Need at least 2 pairs to split into train/eval; got {n}.")
    idx = max(1, int(n * (1 - eval_fraction)))
    return min(idx, n - 1)


def _cut_bucket(counts: list[tuple[str, int]], cut: int) -> tuple[str, int, int]:
    """(bucket holding the cut, rows needed from it, its size) for sorted bucket counts."""
    before = 0
    for b, c in counts:
        if before + c >= cut:
            return b, cut - before, c
        before += c
    b, c = counts[-1]
    return b, c, c


def train_eval_split(df: DataFrame, id_col: str = "pair_id", eval_fraction: float = 0.2,
                     seed: int = 42, digits: int = 4, max_ranked_rows: int = 2_000_000) -> DataFrame:
    """Add ``split`` ('train' / 'eval') to every row of ``df`` (ids must be unique).

    Rows are bucketed by the leading ``digits`` hex digits of the seeded hash; one small
    aggregate counts the buckets (at most 16**digits rows reach the driver). While the bucket
    holding the cut has more than ``max_ranked_rows`` rows it is split again by four more
    digits (an aggregate over that bucket's rows only), so what is ordered stays bounded
    whatever the table size. The cut itself is one (hash, id); every row is decided by a
    comparison with it, with no window and no shuffle of the table.
    """
    h = df.withColumn("_h", seeded_hash(id_col, seed))
    counts = sorted((r["_b"], r["c"]) for r in
                    h.groupBy(F.substring("_h", 1, digits).alias("_b"))
                    .agg(F.count(F.lit(1)).alias("c")).collect())
    n = sum(c for _, c in counts)
    cut = cut_index(n, eval_fraction)
    prefix, need, size = _cut_bucket(counts, cut)
    while size > max_ranked_rows and len(prefix) < 32:
        width = min(32, len(prefix) + 4)
        sub = sorted((r["_b"], r["c"]) for r in
                     h.filter(F.substring("_h", 1, len(prefix)) == prefix)
                     .groupBy(F.substring("_h", 1, width).alias("_b"))
                     .agg(F.count(F.lit(1)).alias("c")).collect())
        prefix, need, size = _cut_bucket(sub, need)
    # The last training row in the order (hash, id), from the cut bucket alone.
    last = (h.filter(F.substring("_h", 1, len(prefix)) == prefix).select("_h", F.col(id_col).alias("_id"))
            .orderBy("_h", "_id").limit(need).agg(F.max(F.struct("_h", "_id")).alias("k")).first()["k"])
    train = (F.col("_h") < last["_h"]) | ((F.col("_h") == last["_h"]) & (F.col(id_col) <= F.lit(last["_id"])))
    return h.withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("eval"))).drop("_h")


def leakage_report(split: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """Counts of both sides and of ids present on both (must be 0): one shuffle by id."""
    per_id = split.groupBy(id_col).agg(
        F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "eval").alias("e"))
    return per_id.agg(F.sum("t").cast("long").alias("n_train"), F.sum("e").cast("long").alias("n_eval"),
                      F.count_if((F.col("t") > 0) & (F.col("e") > 0)).cast("long").alias("n_overlap"))
