"""Distributed connected components by alternating large-star and small-star steps.

Each step is a minimum per node (combined map-side, so a hub is no hot group) and a join with
those minima on one row per node, which AQE can split on the edge side. Edge lists are written
to the shared checkpoint folder after each round, and the list before goes; nothing but two totals
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import removed, saved


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each larger neighbour of a node below the node's smallest neighbour."""
    m = _minima(edges).withColumnRenamed("a", "n")
    return (edges.join(m, edges.b == m.n, "left")
            .select("a", F.coalesce("m", "b").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang the smaller neighbours of a node, and the node, below the smallest."""
    m = _minima(edges).withColumnRenamed("a", "n")
    j = edges.join(m, edges.a == m.n)
    return (j.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(m.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct())


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links of any orderable type -> (node, component): the smallest node reachable.

    Null ends and loops are no links; repeated and reversed links count once. A node without
    a link has no row (it is its own component). An empty input gives an empty output.
    """
    edges = saved(links.where("a is not null and b is not null and a != b")
                  .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        n, digest = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == 0 or (n, digest) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = (n, digest)
        before, edges = edges, saved(_small_star(_large_star(edges)), name)
        removed(before)
