"""Exact top-k joins in which neither side is broadcast, and blocks that cannot matter never meet.

``cells``: corpus rows go to the nearest of some pivots. A cell is described by its radius and, along
and across its pivot's direction, by the range of its rows; with them the inner product of a query and
any row of the cell has an upper bound. Pass 1 sends each query to its most promising cells, until they
hold enough rows; the k-th score found there is what a row must reach. Pass 2 sends it to each other
cell whose bound reaches that score, and to no other.

``ranges``: for as-of searches the corpus is cut by its key (run, ordinal) into ranges. A query goes to
the ranges whose least key is below its own; later ones never meet it.

Neighbouring cells share a group, as many as a task holds; a query goes to a group once, with the list of
its cells there. Queries are sent in turns, so that a turn's copies are fewer than the rows of both tables.

Groups and ranges are cut further into parts of bounded size, by counts, and so are the queries that go
to one of them, so no task holds more than a part of each, however skewed the keys and the cells are.
Descriptions, one row per cell or range and at most ``max_blocks``, are all that reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.similarity import (HITS_SCHEMA, _arrow_matrix, _best_of, _count_keys_below, _hits_batch, _merge_partial, _met, _MAX_SCORE_CELLS,
                                          _reaching, _side_bytes, _side_from_batch, _size_of, _sorted_by_keys, _Side)
from tessera.session import removed, saved_alone, together

MAX_BLOCKS = 4096
#: Ranges of an as-of search; ``block_bytes`` is the least size of one. More are made only where a range
#: of the largest block (bytes) would not hold its share.
MAX_RANGES, LARGEST_BLOCK = 32, 32 * 1024 * 1024
#: Cells of one bound matrix (queries x corpus cells) that a task holds.
_BOUND_CELLS = 1024 * 1024
#: Copies of queries in one turn, at least; beyond, a quarter of the rows of both tables.
TURN_ROWS = 200_000
#: Bytes of corpus copies up to which queries are dealt to more tasks than their number asks for.
SPREAD_BYTES = 256 * 1024 * 1024
#: Hits that a task gathers before it keeps the best k of each query.
_GATHERED = 1 << 20


def _ddl(df: DataFrame, *more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + list(more))


def _meet(q: DataFrame, c: DataFrame, k: int, exclude_self: bool, key_q, key_c, rows_per_part: int, stats: dict, what: str) -> DataFrame:
    """Hits of queries with the blocks they go to (``_b``), at most k per query and task. Both
    frames are saved ones; blocks' sizes are counted, and parts follow from them."""
    nq = {r["_b"]: r["n"] for r in q.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}
    nc = {r["_b"]: r["n"] for r in c.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [(b, max(1, math.ceil(n / rows_per_part)), max(1, math.ceil(nc[b] / rows_per_part))) for b, n in nq.items() if b in nc]
    stats[f"{what}_pairs"] = sum(nq[b] * nc[b] for b, *_ in parts)
    stats[f"{what}_copies"] = sum(nq[b] * pc + nc[b] * pq for b, pq, pc in parts)
    if not parts:
        return q.sparkSession.createDataFrame([], HITS_SCHEMA)
    qx, cx = _dealt(q, c, parts)
    by = ["_b", "_pq", "_pc"]
    return qx.groupBy(*by).cogroup(cx.groupBy(*by)).applyInArrow(_met(k, exclude_self, key_q, key_c), HITS_SCHEMA)


def _dealt(q: DataFrame, c: DataFrame, parts: list[tuple[int, int, int]]) -> tuple[DataFrame, DataFrame]:
    """Both frames by block and part, with a copy of each part for each of the other side."""
    to = F.broadcast(q.sparkSession.createDataFrame(parts, "_b long, _nq int, _nc int"))

    def dealt(df, own, n, other, m, id_col):
        # A part of its own, and a copy for each part of the other side.
        return df.join(to, "_b").withColumn(own, F.pmod(F.xxhash64(id_col), F.col(n)).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("_nq", "_nc")

    return dealt(q, "_pq", "_nq", "_pc", "_nc", "_qid"), dealt(c, "_pc", "_nc", "_pq", "_nq", "_cid")


def _to_blocks(q: DataFrame, choose, blocks: int) -> DataFrame:
    """Each query once per block that ``choose(matrix, batch of the valid rows)`` gives it (a mask)."""
    schema = _ddl(q, "_b long")
    names = q.columns

    def run(batches):
        for whole in batches:
            step = max(1, min(4096, _BOUND_CELLS // max(1, blocks)))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                valid, mat = _arrow_matrix(b.column("_qvec"))
                rows = np.flatnonzero(valid)
                if not len(rows):
                    continue
                row, block = np.nonzero(choose(mat, b.take(pa.array(rows))))
                for i in range(0, len(row), 1 << 14):
                    some = b.take(pa.array(rows[row[i:i + (1 << 14)]]))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(block[i:i + (1 << 14)].astype(np.int64))], [*names, "_b"])

    return q.mapInArrow(run, schema)


def _neighbours(pivots: np.ndarray) -> np.ndarray:
    """An order of the pivots in which near ones stand together: cut in halves along the widest dimension, again and again."""
    out, todo = [], [np.arange(len(pivots))]
    while todo:
        some = todo.pop()
        if len(some) < 3:
            out.append(some)
            continue
        x = pivots[some]
        some = some[np.argsort(x[:, np.argmax(x.max(0) - x.min(0))], kind="stable")]
        todo += [some[len(some) // 2:], some[:len(some) // 2]]
    return np.concatenate(out)


class _Groups:
    """Cells in groups of at most ``rows`` rows (or one cell), neighbours together."""

    def __init__(self, order: np.ndarray, n: np.ndarray, rows: int):
        self.order, self.n = order, n[order]
        starts, held = [0], 0
        for at, x in enumerate(self.n):
            if held and held + x > rows:
                starts.append(at)
                held = 0
            held += x
        self.starts = np.array([*starts, len(order)])

    def members(self) -> list[tuple[int, int, int]]:
        """(cell, group, place in the group)"""
        return [(int(self.order[at]), g, int(at - a)) for g, (a, b) in enumerate(zip(self.starts[:-1], self.starts[1:])) for at in range(a, b)]


def _to_groups(q: DataFrame, choose, groups: _Groups) -> DataFrame:
    """Each query once per group (``_b``) in which ``choose(matrix, batch of the valid rows)`` gives it a cell,
    with those cells as bits and the number of their rows."""
    schema, names = _ddl(q, "_b long", "_cells binary", "_pairs long"), q.columns

    def run(batches):
        for whole in batches:
            step = max(1, min(4096, _BOUND_CELLS // max(1, len(groups.order))))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                valid, mat = _arrow_matrix(b.column("_qvec"))
                rows = np.flatnonzero(valid)
                if not len(rows):
                    continue
                mask = choose(mat, b.take(pa.array(rows)))[:, groups.order]
                for g, (x, y) in enumerate(zip(groups.starts[:-1], groups.starts[1:])):
                    here = np.flatnonzero(mask[:, x:y].any(axis=1))
                    if len(here):
                        cells = mask[here, x:y]
                        bits = [r.tobytes() for r in np.packbits(cells, axis=1)]
                        yield pa.RecordBatch.from_arrays(
                            [*b.take(pa.array(rows[here])).columns, pa.array(np.full(len(here), g)), pa.array(bits, pa.binary()),
                             pa.array((cells * groups.n[x:y]).sum(axis=1).astype(np.int64))], [*names, "_b", "_cells", "_pairs"])

    return q.mapInArrow(run, schema)


def _met_cells(k: int, exclude_self: bool, key_q, key_c):
    """Body of a cogroup of a group's queries and rows: cell by cell, the best k of the queries that chose it."""

    def batch_of(t: pa.Table) -> pa.RecordBatch:
        return t.combine_chunks().to_batches()[0]

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return pa.Table.from_batches([_hits_batch(*[np.zeros(0, np.int64)] * 3, np.zeros(0))])
        mine, theirs = batch_of(mine), batch_of(theirs)
        q, c = _side_from_batch(mine, "_qid", "_qvec", key_q), _side_from_batch(theirs, "_cid", "_cvec", key_c)
        if q.mat.shape[1] != c.mat.shape[1]:
            raise ValueError(f"dimension mismatch: {q.mat.shape[1]} vs {c.mat.shape[1]}")
        chosen = np.frombuffer(b"".join(mine.column("_cells").to_pylist()), np.uint8).reshape(mine.num_rows, -1)
        reach = np.full(len(q.ids), -np.inf)
        if "_reach" in mine.schema.names:
            reach = mine.column("_reach").fill_null(-np.inf).to_numpy(zero_copy_only=False)
        norm = np.linalg.norm(q.mat, axis=1) * np.linalg.norm(c.mat, axis=1).max()
        reach = reach - 1e-12 * norm  # rounding differs by the shape of a product
        at = theirs.column("_at").to_numpy(zero_copy_only=False)
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order])) + 1
        best, held, n = None, [], 0

        def kept():
            x = [np.concatenate([h[i] for h in held]) for i in range(3)]
            row, _, cid, score = _best_of((np.zeros(0, np.int64), None, np.zeros(0, np.int64), np.zeros(0)) if best is None else best, (x[0], None, x[1], x[2]), k)
            return row, None, cid, score

        for cell in np.split(order, cuts):
            place = int(at[cell[0]])
            rows = np.flatnonzero(chosen[:, place >> 3] >> (7 - (place & 7)) & 1)
            if not len(rows):
                continue
            x = _sorted_by_keys(_Side(c.ids[cell], c.mat[cell], c.keys[cell] if c.keys is not None else None))
            srt = np.argsort(x.ids, kind="stable")
            ids = x.ids[srt]
            step = max(1, _MAX_SCORE_CELLS // len(cell))
            for r in range(0, len(rows), step):
                some = rows[r:r + step]
                s = q.mat[some] @ x.mat.T
                if x.keys is not None:
                    s[np.arange(len(cell)) >= _count_keys_below(x.keys, q.keys[some])[:, None]] = -np.inf
                if exclude_self:
                    own = np.clip(np.searchsorted(ids, q.ids[some]), 0, len(ids) - 1)
                    hit = np.flatnonzero(ids[own] == q.ids[some])
                    s[hit, srt[own[hit]]] = -np.inf
                row, cid, score = _reaching(s, x.ids, k, reach[some])
                held.append((some[row], cid, score))
                n += len(row)
                if n > _GATHERED:
                    best, held, n = kept(), [], 0
        if held:
            best = kept()
        if best is None:
            return pa.Table.from_batches([_hits_batch(*[np.zeros(0, np.int64)] * 3, np.zeros(0))])
        row, _, cid, score = best
        rank = np.arange(1, len(row) + 1) - np.searchsorted(row, row, side="left")
        return pa.Table.from_batches([_hits_batch(q.ids[row], rank, cid, score)])

    return run


def _meet_groups(q, choose, groups: _Groups, c: DataFrame, turns: int, k: int, exclude_self: bool, key_q, key_c, rows_per_part: int, stats: dict, what: str) -> list[DataFrame]:
    """Hits of queries in the cells that they choose, at most k per query and task, saved by turns: ``q(condition)`` gives a
    turn's queries. ``c`` is a saved frame."""
    spark = c.sparkSession
    nc = {r["_b"]: r["n"] for r in c.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}
    stats.update({f"{what}_{x}": 0 for x in ("pairs", "copies", "most")})
    out, d = [], _size_of(c, "_cvec")[1]
    cores = spark.sparkContext.defaultParallelism
    spread = max(1, SPREAD_BYTES // _side_bytes(sum(nc.values()), d))
    for turn in range(turns):
        sent = saved_alone(_to_groups(q(lambda i: f"pmod(xxhash64({i}), {turns}) = {turn}"), choose, groups), f"cells-{what}")
        told = sent.groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.sum("_pairs").alias("pairs")).collect()
        told = [r for r in told if r["_b"] in nc]
        least = min(spread, math.ceil(cores / max(1, len(told))))  # parts of queries, so that no core is idle
        parts = [(r["_b"], max(least, math.ceil(r["n"] / rows_per_part)), max(1, math.ceil(nc[r["_b"]] / rows_per_part))) for r in told]
        stats[f"{what}_pairs"] += sum(r["pairs"] for r in told)
        n = {r["_b"]: r["n"] for r in told}
        copies = sum(n[b] * pc + nc[b] * pq for b, pq, pc in parts)
        stats[f"{what}_copies"] += copies
        stats[f"{what}_most"] = max(stats[f"{what}_most"], copies)
        if parts:
            by = ["_b", "_pq", "_pc"]
            tasks = min(MAX_BLOCKS, sum(pq * pc for _, pq, pc in parts))  # they are few bytes and much work
            qx, cx = (x.repartition(tasks, *by) for x in _dealt(sent.drop("_pairs"), c, parts))
            met = qx.groupBy(*by).cogroup(cx.groupBy(*by)).applyInArrow(_met_cells(k, exclude_self, key_q, key_c), HITS_SCHEMA)
            out.append(saved_alone(_merge_partial(met, k), f"cells-{what}-hits"))
        removed(sent)
    return out


def _below(b: pa.RecordBatch, key_q, least: np.ndarray | None) -> np.ndarray:
    """Which blocks hold a key below each query's: (queries, blocks), or all."""
    if key_q is None:
        return np.ones((b.num_rows, 1), bool)
    run, ordinal = (b.column(x).to_numpy(zero_copy_only=False)[:, None] for x in key_q)
    return (least[:, 0] < run) | ((least[:, 0] == run) & (least[:, 1] < ordinal))


class _Cells:
    """What is known of the cells: pivots, and the ranges of their rows."""

    def __init__(self, pivots: np.ndarray, rows: list, keyed: bool):
        m = len(pivots)
        self.pivots = pivots
        norms = np.linalg.norm(pivots, axis=1)
        self.unit = pivots / np.where(norms > 0, norms, 1.0)[:, None]
        self.n, self.radius, self.low, self.high, self.across = (np.zeros(m) for _ in range(5))
        self.least = np.zeros((m, 2), np.int64) if keyed else None
        for r in rows:
            b = r["_b"]
            self.n[b], self.radius[b], self.low[b], self.high[b], self.across[b] = r["n"], r["radius"], r["low"], r["high"], r["across"]
            if keyed:
                self.least[b] = tuple(r["least"])

    def place(self, mat: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each row the nearest pivot, the distance to it, and its share along and across."""
        best = np.zeros(len(mat), np.int64)
        for at in range(0, len(mat), 1024):
            x = mat[at:at + 1024]
            best[at:at + 1024] = np.argmin((self.pivots ** 2).sum(1) - 2 * x @ self.pivots.T, axis=1)
        along = np.einsum("ij,ij->i", mat, self.unit[best])
        across = np.linalg.norm(mat - along[:, None] * self.unit[best], axis=1)
        return best, np.linalg.norm(mat - self.pivots[best], axis=1), along, across

    def bounds(self, mat: np.ndarray) -> np.ndarray:
        """No inner product with a row of a cell is above this; with a little room for rounding."""
        along = mat @ self.unit.T
        norm = np.linalg.norm(mat, axis=1)[:, None]
        across = np.sqrt(np.maximum(norm ** 2 - along ** 2, 0))
        by_shares = np.maximum(along * self.low, along * self.high) + across * self.across
        by_radius = mat @ self.pivots.T + norm * self.radius
        out = np.minimum(by_shares, by_radius)
        return np.where(self.n > 0, out + 1e-7 * (norm * (np.abs(self.high) + np.abs(self.low) + self.across + self.radius) + 1e-30), -np.inf)

    def first(self, mat: np.ndarray, b: pa.RecordBatch, key_q, k: int) -> np.ndarray:
        """The most promising cells of each query, until they hold more than k rows."""
        score = np.where((self.n > 0) & _below(b, key_q, self.least), mat @ self.pivots.T, -np.inf)
        order = np.argsort(-score, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros_like(score, bool)
        np.put_along_axis(out, order, (before <= k) & np.isfinite(np.take_along_axis(score, order, axis=1)), axis=1)
        return out


def plan_cells(q: DataFrame, c: DataFrame, k: int, exclude_self: bool, key_q, key_c, block_bytes: int, sizes: dict, stats: dict,
               cell_rows: int | None = None, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    spark = q.sparkSession
    nc, d = sizes.get("c") or _size_of(c, "_cvec")
    rows_per_part = max(1, block_bytes // _side_bytes(1, d))
    m = min(max_blocks, max(1, math.ceil(nc / (cell_rows or rows_per_part))))
    # Pivots: rows with the least hashes, so the same ones in every run.
    some = c.where(F.size("_cvec") > 0).orderBy(F.xxhash64("_cid"), "_cid").limit(m).select("_cvec").toArrow()
    if not some.num_rows:
        return spark.createDataFrame([], HITS_SCHEMA)
    pivots = np.unique(_arrow_matrix(some.column(0).combine_chunks())[1], axis=0)
    blank = _Cells(pivots, [], False)
    names = c.columns

    def place(batches):
        for b in batches:
            valid, mat = _arrow_matrix(b.column("_cvec"))
            if valid.any():
                cell, radius, along, across = blank.place(mat)
                kept = b.filter(pa.array(valid))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell), pa.array(radius), pa.array(along), pa.array(across)],
                                                 [*names, "_b", "radius", "along", "across"])

    found = saved_alone(c.mapInArrow(place, _ddl(c, "_b long, radius double, along double, across double")), "cells-placed")
    told = [F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("across").alias("across")]
    if key_c is not None:
        told.append(F.min(F.struct(*key_c)).alias("least"))
    known = _Cells(pivots, found.groupBy("_b").agg(*told).collect(), key_c is not None)
    cells = spark.sparkContext.broadcast(known)
    groups = _Groups(_neighbours(pivots), known.n, rows_per_part)
    of = F.broadcast(spark.createDataFrame(groups.members(), "_b long, _g long, _at int"))
    placed = found.drop("radius", "along", "across").join(of, "_b").drop("_b").withColumnRenamed("_g", "_b")
    nq = (sizes.get("q") or _size_of(q, "_qvec"))[0]
    most = max(TURN_ROWS, (nq + nc) // 4)

    def first(mat, b):
        return cells.value.first(mat, b, key_q, k)

    hits = _meet_groups(lambda own: q.where(own("_qid")), first, groups, placed, math.ceil(2 * nq / most) or 1, k, exclude_self, key_q, key_c,
                        rows_per_part, stats, "first")
    if not hits:
        removed(found)
        return spark.createDataFrame([], HITS_SCHEMA)
    every = saved_alone(_merge_partial(together(hits), k), "cells-hits")
    removed(*hits)
    hits = every
    reach = hits.groupBy(F.col("query_id").alias("_qid")).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("_reach"))

    def second(mat, b):
        x = cells.value
        reach_ = b.column("_reach").fill_null(-np.inf).to_numpy(zero_copy_only=False)[:, None]
        out = np.zeros((len(mat), len(x.n)), bool)
        step = max(1, _BOUND_CELLS // len(x.n))
        for at in range(0, len(mat), step):
            rows = slice(at, at + step)
            part = b.slice(at, step)
            bound = x.bounds(mat[rows])
            out[rows] = (bound >= reach_[rows]) & (x.n > 0) & _below(part, key_q, x.least) & ~x.first(mat[rows], part, key_q, k)
        return out

    more = _meet_groups(lambda own: q.where(own("_qid")).join(reach.where(own("_qid")), "_qid", "left"), second, groups, placed,
                        math.ceil(nq * (len(groups.starts) - 1) / most) or 1, k, exclude_self, key_q, key_c, rows_per_part, stats, "second")
    removed(found)
    return _merge_partial(together([hits, *more]), k)


def plan_ranges(q: DataFrame, c: DataFrame, k: int, exclude_self: bool, key_q, key_c, block_bytes: int, sizes: dict, stats: dict,
                max_blocks: int = MAX_BLOCKS, max_ranges: int = MAX_RANGES) -> DataFrame:
    if key_q is None:
        raise ValueError("ranges need an as-of key")
    spark = q.sparkSession
    nc, d = sizes.get("c") or _size_of(c, "_cvec")
    rows_per_part = max(1, block_bytes // _side_bytes(1, d))
    # No more than ``max_ranges`` while they fit the largest block, so that the copies of a query, one per
    # range below its key, are as many in a larger table.
    largest = max(rows_per_part, LARGEST_BLOCK // _side_bytes(1, d))
    rows_per_part = min(largest, max(rows_per_part, math.ceil(nc / max_ranges)))
    m = min(max_blocks, max(1, math.ceil(nc / rows_per_part)))
    # A range is what one task of a range partitioning holds; equal keys are in one, which is cut
    # into parts when it is large. Saved, so that the numbers stay.
    whole = " and ".join(f"{x} is not null" for x in key_c)
    ranged = c.where(whole).repartitionByRange(m, *key_c).withColumn("_b", F.spark_partition_id().cast("long")).checkpoint(eager=True)
    found = sorted((r["_b"], tuple(r["least"])) for r in ranged.groupBy("_b").agg(F.min(F.struct(*key_c)).alias("least")).collect())
    if not found:
        return spark.createDataFrame([], HITS_SCHEMA)
    least = np.full((found[-1][0] + 1, 2), np.iinfo(np.int64).max)
    for b, key in found:
        least[b] = key
    told = spark.sparkContext.broadcast(least)
    keyed = q.where(" and ".join(f"{x} is not null" for x in key_q))
    sent = _to_blocks(keyed, lambda mat, b: _below(b, key_q, told.value), len(least)).checkpoint(eager=True)
    return _merge_partial(_meet(sent, ranged, k, exclude_self, key_q, key_c, rows_per_part, stats, "ranges"), k)
