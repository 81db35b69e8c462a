"""Exact top-k similarity join by inner product (the retrieval step).

Semantics: for every query vector, the ``k`` corpus rows with the largest inner product,
best first, ties broken by smaller corpus id; fewer than ``k`` rows when fewer are
visible; none for an empty corpus. Optional filters:

* ``exclude_self``: a query never retrieves the corpus row with its own id
  (leave-one-out retrieval when queries and corpus are the same table);
* ``asof``: a query only sees corpus rows whose ``(run, ordinal)`` key is strictly
  smaller than its own (lessons written by earlier runs or earlier items of its run).

A corpus above the broadcast bound is first relieved of the rows that no top-k can hold (equal
vectors tie, so a few with the least ids stand for all). Physical strategies, picked from a size check
(never from a guess):

1. ``broadcast_corpus``: the corpus fits the broadcast bound. Queries stay where they are
   and each Arrow batch is scored against the broadcast matrix. No shuffle at all.
2. ``broadcast_queries``: the queries fit the bound, the corpus does not. Corpus
   partitions are scored against the broadcast query matrix, each partition keeps its
   local top-k per query, and one window merges the partial lists (the shuffle carries
   at most ``k`` rows per query and partition).
3. neither side fits: ``cells``, or ``ranges`` for an as-of search (:mod:`similarity_cells`).
   The corpus is cut by pivots or by its key, and a query meets only the blocks that may hold
   one of its hits. ``blocked``, on request: every hash block of queries meets every one of the
   corpus. Memory per task is bounded by the block size, whatever the table sizes.

No strategy materialises the pairs: a task computes one score matrix per chunk and emits
top-k rows only.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import saved_alone

HITS_SCHEMA = "query_id long, rank long, id long, score double"

DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024    # bytes of float64 matrix we accept to broadcast
DEFAULT_BLOCK_BYTES = 32 * 1024 * 1024         # bytes per side in one blocked task
_MAX_SCORE_CELLS = 1024 * 1024                 # cells of one float64 score chunk (8 MB)
_SCORE_COLUMNS = 1 << 14                       # corpus rows of one score chunk
_PRUNED_BYTES = 64 * 1024 * 1024               # bytes of vectors in which a task looks for equal ones


def _side_bytes(n: int, d: int) -> int:
    """Size of a side as tasks hold it: float64 values, an id and two as-of keys a row."""
    return n * (max(d, 1) * 8 + 24)


@dataclass
class _Side:
    ids: np.ndarray            # int64 (n,)
    mat: np.ndarray            # float64 (n, d)
    keys: np.ndarray | None    # (n, 2) int64 as-of keys, or None


# ----------------------------------------------------------------------------- kernels


def _arrow_matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """List<float> column -> (valid row mask, float64 matrix of the valid rows)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros(0, dtype=bool), np.zeros((0, 0))
    lengths = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    valid = np.asarray(col.is_valid().to_numpy(zero_copy_only=False)) & (lengths > 0)
    if not valid.any():
        return valid, np.zeros((0, 0))
    sub = col.filter(pa.array(valid))
    d = int(lengths[valid][0])
    if not np.all(lengths[valid] == d):
        raise ValueError("vectors of different lengths in one column")
    flat = sub.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return valid, flat.reshape(len(sub), d)


def _topk_rows(scores: np.ndarray, cids: np.ndarray, k: int):
    """Exact top-k of every row of ``scores`` (-inf = not visible).

    Returns (row index, rank, corpus id, score) arrays, best first, ties by smaller id.
    """
    b, n = scores.shape
    kk = min(k, n)
    if kk == 0 or b == 0:
        e = np.zeros(0, dtype=np.int64)
        return e, e, e, np.zeros(0)
    if kk < n:
        part = np.argpartition(-scores, kk - 1, axis=1)[:, :kk]
    else:
        part = np.broadcast_to(np.arange(n), (b, n)).copy()
    psc = np.take_along_axis(scores, part, axis=1)
    pid = cids[part]
    if kk < n:
        # Rows whose k-th score is tied with unselected columns: redo exactly so the
        # smallest ids win the tie.
        kth = psc.min(axis=1)
        tied = np.nonzero(np.isfinite(kth) & ((scores >= kth[:, None]).sum(axis=1) > kk))[0]
        for r in tied:
            cand = np.nonzero(scores[r] >= kth[r])[0]
            order = np.lexsort((cids[cand], -scores[r, cand]))[:kk]
            part[r] = cand[order]
        if len(tied):
            psc = np.take_along_axis(scores, part, axis=1)
            pid = cids[part]
    order = np.lexsort((pid, -psc), axis=1)
    psc = np.take_along_axis(psc, order, axis=1)
    pid = np.take_along_axis(pid, order, axis=1)
    rows = np.repeat(np.arange(b), kk)
    ranks = np.tile(np.arange(1, kk + 1, dtype=np.int64), b)
    flat_sc = psc.reshape(-1)
    keep = np.isfinite(flat_sc)
    return rows[keep], ranks[keep], pid.reshape(-1)[keep], flat_sc[keep]


def _kth(rows: np.ndarray, scores: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th score of each of ``n`` rows in a list ordered by row and score; -inf where there are fewer."""
    ends = np.searchsorted(rows, np.arange(n), side="right")
    full = ends - np.searchsorted(rows, np.arange(n), side="left") >= k
    out = np.full(n, -np.inf)
    out[full] = scores[ends[full] - 1]
    return out


def _reaching(scores: np.ndarray, cids: np.ndarray, k: int, reach: np.ndarray):
    """(row index, corpus id, score) of what may still enter a list whose k-th score is ``reach``. Rows
    in which many do are ranked first, so that no more than k a row are kept of them."""
    hit = (scores >= reach[:, None]) & np.isfinite(scores)
    many = np.flatnonzero(hit.sum(axis=1) > 4 * k)
    if len(many):
        hit[many] = False
    rows, cols = np.nonzero(hit)
    cid, sc = cids[cols], scores[rows, cols]
    if len(many):
        row, _, more, best = _topk_rows(scores[many], cids, k)
        rows, cid, sc = np.concatenate([rows, many[row]]), np.concatenate([cid, more]), np.concatenate([sc, best])
    return rows, cid, sc


def _score_and_rank(q: _Side, c: _Side, k: int, exclude_self: bool):
    """Top-k of every query against the corpus, in memory-bounded chunks.

    Returns (query id, rank, corpus id, score) numpy arrays.
    """
    out_q, out_r, out_c, out_s = [], [], [], []
    nq, nc = len(q.ids), len(c.ids)
    if nq == 0 or nc == 0:
        e = np.zeros(0, dtype=np.int64)
        return e, e, e, np.zeros(0)
    if q.mat.shape[1] != c.mat.shape[1]:
        raise ValueError(f"dimension mismatch: {q.mat.shape[1]} vs {c.mat.shape[1]}")
    # Corpus is ordered by its as-of key, so the visible part of a query is a prefix.
    c = _sorted_by_keys(c)
    col_pos = None
    if exclude_self:
        srt = np.argsort(c.ids, kind="stable")
        col_pos = (c.ids[srt], srt)
    col_chunk = max(1, min(nc, _SCORE_COLUMNS))
    row_chunk = max(1, _MAX_SCORE_CELLS // col_chunk)
    for r0 in range(0, nq, row_chunk):
        r1 = min(nq, r0 + row_chunk)
        qm = q.mat[r0:r1]
        qids = q.ids[r0:r1]
        visible_upto = None
        if c.keys is not None:
            # number of corpus keys strictly below each query key, lexicographic on (run, ord)
            visible_upto = _count_keys_below(c.keys, q.keys[r0:r1])
        best = None
        for c0 in range(0, nc, col_chunk):
            c1 = min(nc, c0 + col_chunk)
            s = qm @ c.mat[c0:c1].T
            if visible_upto is not None:
                cols = np.arange(c0, c1)
                s[cols[None, :] >= visible_upto[:, None]] = -np.inf
            if col_pos is not None:
                sorted_ids, srt = col_pos
                at = np.searchsorted(sorted_ids, qids)
                at = np.clip(at, 0, len(sorted_ids) - 1)
                hit = sorted_ids[at] == qids
                pos = srt[at]
                inside = hit & (pos >= c0) & (pos < c1)
                rr = np.nonzero(inside)[0]
                s[rr, pos[rr] - c0] = -np.inf
            if best is None:
                rows, _, cid, sc = _topk_rows(s, c.ids[c0:c1], k)
            else:
                rows, cid, sc = _reaching(s, c.ids[c0:c1], k, reach)
            if best is None:
                best = (rows, cid, sc)
            else:
                # merge with the list so far: order by (row, -score, id), keep the first k per row
                rows, _, cid, sc = _best_of((best[0], None, best[1], best[2]), (rows, None, cid, sc), k)
                best = (rows, cid, sc)
            reach = _kth(best[0], best[2], len(qids), k)
        rows, cid, sc = best
        starts = np.searchsorted(rows, rows, side="left") if len(rows) else rows
        rank = np.arange(len(rows)) - starts + 1
        out_q.append(qids[rows])
        out_r.append(rank.astype(np.int64))
        out_c.append(cid)
        out_s.append(sc)
    return (np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_c),
            np.concatenate(out_s))


def _same(mat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each different vector, and each row's number among those. Rows are told apart
    by a hash; should two vectors share one, by their bytes."""
    rows = np.ascontiguousarray(mat + 0.0)  # -0.0 and 0.0 are one value
    bits = rows.view(np.uint64)
    odd = np.random.default_rng(7).integers(1, 1 << 63, rows.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = ((bits ^ (bits >> np.uint64(29))) * odd).sum(axis=1, dtype=np.uint64)
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    of = of.ravel()
    if not np.array_equal(bits, bits[first[of]]):
        _, first, of = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        of = of.ravel()
    return first, of


def _few_of_each(c: _Side, k: int) -> _Side:
    """The corpus without rows that no top-k can hold: of equal vectors those with the k + 1 least ids
    (one of them may be the query itself). With as-of keys, those with the k + 1 least ids up to their
    own key: a query that sees a row sees all rows of no greater key."""
    keep = _few_rows(c, k)
    return c if keep is None else _Side(c.ids[keep], c.mat[keep], c.keys[keep] if c.keys is not None else None)


def _few_rows(c: _Side, k: int) -> np.ndarray | None:
    """The rows that ``_few_of_each`` keeps; None for all."""
    if len(c.ids) <= k + 1:
        return None
    first, of = _same(c.mat)
    if len(first) == len(c.ids):
        return None
    if c.keys is not None:
        return np.sort(_least_so_far(of, c, k))
    order = np.lexsort((c.ids, of))
    nth = np.arange(len(order)) - np.searchsorted(of[order], of[order], side="left")
    return np.sort(order[nth <= k])


def _least_so_far(of: np.ndarray, c: _Side, k: int) -> np.ndarray:
    """Rows that are among the k + 1 least ids of their group ``of`` when the group is read by key."""
    order = np.lexsort((c.ids, c.keys[:, 1], c.keys[:, 0], of))
    kept, group, least = [], -1, []
    for row, g, i in zip(order.tolist(), of[order].tolist(), c.ids[order].tolist()):
        if g != group:
            group, least = g, []
        if len(least) <= k:
            heapq.heappush(least, -i)
        elif i < -least[0]:
            heapq.heapreplace(least, -i)
        else:
            continue
        kept.append(row)
    return np.array(kept, np.int64)


def _without_hopeless(c: DataFrame, k: int, key_c, seen_bytes: int = _PRUNED_BYTES) -> DataFrame:
    """The corpus without rows that no top-k can hold (``_few_of_each``): first in the partitions as
    they are, then where equal vectors meet, so only what is left of them is shuffled. A task holds
    ``seen_bytes`` of vectors; where more stay, some equal ones may be kept, which changes no result."""
    names = c.columns

    def left_of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks().to_batches()
        if not whole:
            return batches[0]
        batch = whole[0]
        valid, mat = _arrow_matrix(batch.column("_cvec"))
        valid &= np.asarray(batch.column("_cid").is_valid())
        for x in key_c or ():
            valid &= np.asarray(batch.column(x).is_valid())
        if not valid.all():  # rows without a vector, an id or a key stay: what becomes of them is not decided here
            some = batch.filter(pa.array(valid))
            rest = batch.filter(pa.array(~valid))
            return pa.Table.from_batches([left_of([some]), rest]).combine_chunks().to_batches()[0] if some.num_rows else batch
        ids = batch.column("_cid").to_numpy(zero_copy_only=False).astype(np.int64)
        keys = None
        if key_c:
            keys = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in key_c], axis=1).astype(np.int64)
        kept = _few_rows(_Side(ids, mat, keys), k)
        return batch if kept is None else batch.take(pa.array(kept))

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size > seen_bytes:
                b = left_of(held)
                held, size = [b], b.nbytes
                if 2 * size > seen_bytes:
                    yield from held
                    held, size = [], 0
        if held:
            yield left_of(held)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in c.schema.fields)
    some = c.mapInArrow(run, schema)
    return some.repartition(F.xxhash64("_cvec")).mapInArrow(run, schema).select(*names)


def _rank_for_each(q: _Side, c: _Side, k: int, exclude_self: bool):
    """``_score_and_rank`` in which equal query vectors are scored once; a query's own row goes from
    the list of its vector, which is one longer for that."""
    if q.keys is not None or len(q.ids) < 64:
        return _score_and_rank(q, c, k, exclude_self)
    first, of = _same(q.mat)
    if 2 * len(first) > len(q.ids):
        return _score_and_rank(q, c, k, exclude_self)
    row, rank, cid, score = _score_and_rank(_Side(np.arange(len(first)), q.mat[first], None), c, k + exclude_self, False)
    start = np.searchsorted(row, np.arange(len(first) + 1))
    n = np.diff(start)[of]
    query = np.repeat(np.arange(len(of)), n)
    at = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[:-1][of], n)
    qid, cid, score = q.ids[query], cid[at], score[at]
    if exclude_self:
        other = qid != cid
        query, qid, cid, score = query[other], qid[other], cid[other], score[other]
    rank = np.arange(len(query)) - np.searchsorted(query, query, side="left") + 1
    keep = rank <= k
    return qid[keep], rank[keep].astype(np.int64), cid[keep], score[keep]


def _sorted_by_keys(c: _Side) -> _Side:
    """Corpus ordered by its as-of key (no-op when there is none or it is already sorted)."""
    if c.keys is None or len(c.ids) < 2:
        return c
    k0, k1 = c.keys[:, 0], c.keys[:, 1]
    if np.all((k0[:-1] < k0[1:]) | ((k0[:-1] == k0[1:]) & (k1[:-1] <= k1[1:]))):
        return c
    order = np.lexsort((k1, k0))
    return _Side(c.ids[order], c.mat[order], c.keys[order])


def _count_keys_below(ckeys_sorted: np.ndarray, qkeys: np.ndarray) -> np.ndarray:
    """For each query key, how many sorted corpus keys are lexicographically smaller."""
    run_c, ord_c = ckeys_sorted[:, 0], ckeys_sorted[:, 1]
    lo = np.searchsorted(run_c, qkeys[:, 0], side="left")   # all earlier runs
    hi = np.searchsorted(run_c, qkeys[:, 0], side="right")  # end of the same run
    out = lo.copy()
    for i in np.nonzero(hi > lo)[0]:
        out[i] = lo[i] + np.searchsorted(ord_c[lo[i]:hi[i]], qkeys[i, 1], side="left")
    return out


def _side_from_batch(batch: pa.RecordBatch, id_col: str, vec_col: str,
                     key_cols: tuple[str, str] | None) -> _Side:
    valid, mat = _arrow_matrix(batch.column(vec_col))
    ids = batch.column(id_col).to_numpy(zero_copy_only=False).astype(np.int64)[valid]
    keys = None
    if key_cols is not None:
        keys = np.stack([batch.column(key_cols[0]).to_numpy(zero_copy_only=False),
                         batch.column(key_cols[1]).to_numpy(zero_copy_only=False)],
                        axis=1).astype(np.int64)[valid]
    return _Side(ids, mat, keys)


def _hits_batch(qid, rank, cid, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(qid, pa.int64()), pa.array(rank, pa.int64()),
         pa.array(cid, pa.int64()), pa.array(score, pa.float64())],
        names=["query_id", "rank", "id", "score"])


# ----------------------------------------------------------------------------- planning


def _normalise_inputs(queries: DataFrame, corpus: DataFrame, query_id: str, query_vec: str,
                      corpus_id: str, corpus_vec: str, asof):
    qcols = [F.col(query_id).cast("long").alias("_qid"), F.col(query_vec).alias("_qvec")]
    ccols = [F.col(corpus_id).cast("long").alias("_cid"), F.col(corpus_vec).alias("_cvec")]
    if asof is not None:
        (q_run, q_ord), (c_run, c_ord) = asof
        qcols += [F.col(q_run).cast("long").alias("_qrun"), F.col(q_ord).cast("long").alias("_qord")]
        ccols += [F.col(c_run).cast("long").alias("_crun"), F.col(c_ord).cast("long").alias("_cord")]
    return queries.select(*qcols), corpus.select(*ccols)


def _size_of(df: DataFrame, vec: str) -> tuple[int, int]:
    """(rows, dimension) of a vector table: one small aggregate, no collect of data."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    return int(r["n"] or 0), int(r["d"] or 0)


def _collect_side(df: DataFrame, id_col: str, vec_col: str, key_cols) -> _Side:
    """Bring a side whose size was checked against the broadcast bound to the driver."""
    tbl = df.toArrow()
    rb = pa.RecordBatch.from_arrays([tbl.column(c).combine_chunks() for c in tbl.column_names],
                                    names=tbl.column_names)
    return _side_from_batch(rb, id_col, vec_col, key_cols)


def similarity_topk(queries: DataFrame, corpus: DataFrame, k: int, *,
                    query_id: str = "query_id", query_vec: str = "embedding",
                    corpus_id: str = "id", corpus_vec: str = "embedding",
                    exclude_self: bool = False,
                    asof: tuple[tuple[str, str], tuple[str, str]] | None = None,
                    strategy: str = "auto",
                    broadcast_limit_bytes: int = DEFAULT_BROADCAST_LIMIT,
                    block_bytes: int = DEFAULT_BLOCK_BYTES,
                    lsh: dict | None = None, cells: dict | None = None, stats: dict | None = None) -> DataFrame:
    """Exact top-k inner-product join. Returns ``query_id, rank, id, score`` rows.

    ``asof=((q_run, q_ord), (c_run, c_ord))`` keeps only corpus rows with
    ``(c_run, c_ord) < (q_run, q_ord)``. ``strategy`` is ``auto`` or one of
    ``broadcast_corpus``, ``broadcast_queries``, ``cells``, ``ranges``, ``blocked`` (all exact),
    or ``approx_lsh`` (approximate, only on request; ``lsh`` passes its parameters). ``cells``
    passes parameters of the plan of that name; ``stats``, a dictionary, is told how many
    (query, row) pairs and copied rows the plans of cells and ranges came to.
    """
    spark = queries.sparkSession
    if k is None or k <= 0:
        raise ValueError("k must be positive")
    q, c = _normalise_inputs(queries, corpus, query_id, query_vec, corpus_id, corpus_vec, asof)
    key_q = ("_qrun", "_qord") if asof is not None else None
    key_c = ("_crun", "_cord") if asof is not None else None

    sizes: dict[str, tuple[int, int]] = {}
    if strategy == "auto":
        sizes["c"] = _size_of(c, "_cvec")
        if _side_bytes(*sizes["c"]) > broadcast_limit_bytes:
            # Equal vectors tie for every query: all but a few of them are in no top-k.
            c = saved_alone(_without_hopeless(c, k, key_c), "corpus")
            sizes["c"] = _size_of(c, "_cvec")
        if _side_bytes(*sizes["c"]) <= broadcast_limit_bytes:
            strategy = "broadcast_corpus"
        else:
            sizes["q"] = _size_of(q, "_qvec")
            strategy = "broadcast_queries" if _side_bytes(*sizes["q"]) <= broadcast_limit_bytes else "ranges" if asof else "cells"

    if strategy == "broadcast_corpus":
        return _plan_broadcast_corpus(spark, q, c, k, exclude_self, key_q, key_c,
                                      broadcast_limit_bytes, sizes.get("c"))
    if strategy == "broadcast_queries":
        return _plan_broadcast_queries(spark, q, c, k, exclude_self, key_q, key_c,
                                       broadcast_limit_bytes, sizes.get("q"))
    if strategy == "blocked":
        return _plan_blocked(q, c, k, exclude_self, key_q, key_c, block_bytes, sizes)
    if strategy in ("cells", "ranges"):
        from tessera.operators import similarity_cells
        told = stats if stats is not None else {}
        if strategy == "ranges":
            return similarity_cells.plan_ranges(q, c, k, exclude_self, key_q, key_c, block_bytes, sizes, told)
        return similarity_cells.plan_cells(q, c, k, exclude_self, key_q, key_c, block_bytes, sizes, told, **(cells or {}))
    if strategy == "approx_lsh":
        return _plan_lsh(q, c, k, exclude_self, key_q, key_c, **(lsh or {}))
    raise ValueError(f"unknown strategy {strategy!r}")


def _check_bound(n: int, d: int, limit: int, what: str) -> None:
    size = _side_bytes(n, d)
    if size > limit:
        raise ValueError(f"{what} is {size} bytes, above the broadcast bound of {limit}")


def _plan_broadcast_corpus(spark: SparkSession, q: DataFrame, c: DataFrame, k: int,
                           exclude_self: bool, key_q, key_c, limit: int, size=None) -> DataFrame:
    nc, dc = size or _size_of(c, "_cvec")
    _check_bound(nc, dc, limit, "corpus")
    side = _few_of_each(_sorted_by_keys(_collect_side(c, "_cid", "_cvec", key_c)), k)
    bc = spark.sparkContext.broadcast(side)

    def run(batches):
        cs = bc.value
        for b in batches:
            qs = _side_from_batch(b, "_qid", "_qvec", key_q)
            res = _rank_for_each(qs, cs, k, exclude_self)
            if len(res[0]):
                yield _hits_batch(*res)

    return q.mapInArrow(run, HITS_SCHEMA)


def _plan_broadcast_queries(spark: SparkSession, q: DataFrame, c: DataFrame, k: int,
                            exclude_self: bool, key_q, key_c, limit: int, size=None) -> DataFrame:
    nq, dq = size or _size_of(q, "_qvec")
    _check_bound(nq, dq, limit, "query set")
    side = _collect_side(q, "_qid", "_qvec", key_q)
    bq = spark.sparkContext.broadcast(side)

    def run(batches):
        qs = bq.value
        best = None  # of the partition so far: at most k rows per query
        for b in batches:
            cs = _side_from_batch(b, "_cid", "_cvec", key_c)
            best = _best_of(best, _score_and_rank(qs, cs, k, exclude_self), k)
        if best is not None and len(best[0]):
            yield _hits_batch(*best)

    partial = c.mapInArrow(run, HITS_SCHEMA)
    return _merge_partial(partial, k)


def _best_of(a, b, k: int):
    """The k best hits per query of two hit lists (query id, rank, corpus id, score)."""
    if a is None:
        return b
    qid, cid, score = (np.concatenate([a[i], b[i]]) for i in (0, 2, 3))
    order = np.lexsort((cid, -score, qid))
    qid, cid, score = qid[order], cid[order], score[order]
    rank = np.arange(1, len(qid) + 1) - np.searchsorted(qid, qid, side="left")
    keep = rank <= k
    return qid[keep], rank[keep], cid[keep], score[keep]


def _merge_partial(partial: DataFrame, k: int) -> DataFrame:
    """Final top-k over partial top-k lists; Spark plans it as WindowGroupLimit + window."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return (partial.withColumn("rank", F.row_number().over(w).cast("long"))
            .filter(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))


def _plan_blocked(q: DataFrame, c: DataFrame, k: int, exclude_self: bool, key_q, key_c,
                  block_bytes: int, sizes=None) -> DataFrame:
    sizes = sizes or {}
    nq, dq = sizes.get("q") or _size_of(q, "_qvec")
    nc, dc = sizes.get("c") or _size_of(c, "_cvec")
    qb = max(1, math.ceil(_side_bytes(nq, dq) / block_bytes))
    cb = max(1, math.ceil(_side_bytes(nc, dc) / block_bytes))
    # Each query row is copied to every corpus block and vice versa; a (qb, cb) group holds
    # one block of each side. Ids are unique, so hash blocks are even: no hot group.
    qx = (q.withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.lit(qb)))
           .withColumn("_cb", F.explode(F.sequence(F.lit(0), F.lit(cb - 1)).cast("array<long>"))))
    cx = (c.withColumn("_cb", F.pmod(F.xxhash64("_cid"), F.lit(cb)))
           .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)).cast("array<long>"))))

    partial = (qx.groupBy("_qb", "_cb")
               .cogroup(cx.groupBy("_qb", "_cb"))
               .applyInArrow(_met(k, exclude_self, key_q, key_c), HITS_SCHEMA))
    return _merge_partial(partial, k)


def _met(k: int, exclude_self: bool, key_q, key_c):
    """Body of a cogroup: the local top-k of the group's queries, read from Arrow's list buffers."""
    def side(t: pa.Table, *cols) -> _Side:
        whole = t.combine_chunks()
        batch = whole.to_batches()[0] if whole.num_rows else pa.RecordBatch.from_pylist([], whole.schema)
        return _side_from_batch(batch, *cols)

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if mine.num_rows and theirs.num_rows:
            res = _score_and_rank(side(mine, "_qid", "_qvec", key_q), side(theirs, "_cid", "_cvec", key_c), k, exclude_self)
        else:
            res = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.Table.from_batches([_hits_batch(*res)])

    return run


# ----------------------------------------------------------------------------- helpers


def dot(a, b):
    """Inner product of two array<float> columns, summed in double (native expression)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def l2_normalize(vec, as_float: bool = True):
    """L2-normalise an array column; a zero vector stays zero (native expression).

    The sum of squares is folded once by ``aggregate`` and its finish step rescales the
    array, so the norm is not recomputed per element. ``as_float`` casts the result to
    float32 as an embedding column would be stored; otherwise elements stay double.
    """
    v = F.col(vec) if isinstance(vec, str) else vec
    t = "float" if as_float else "double"
    return F.aggregate(
        v, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"),
        lambda ss: F.transform(v, lambda x: F.when(ss > 0, x.cast("double") / F.sqrt(ss))
                               .otherwise(F.lit(0.0)).cast(t)))


def vector_norm(vec):
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def mean_score(hits: DataFrame, queries: DataFrame, query_id: str = "query_id",
               alias: str = "confidence") -> DataFrame:
    """Mean score of the returned hits per query, 0.0 for a query without hits."""
    agg = hits.groupBy("query_id").agg(F.avg("score").alias("_m"), F.count(F.lit(1)).alias("_n"))
    base = queries.select(F.col(query_id).cast("long").alias("query_id"))
    return (base.join(agg, "query_id", "left")
            .select("query_id", F.coalesce("_m", F.lit(0.0)).alias(alias),
                    F.coalesce("_n", F.lit(0)).cast("long").alias(f"n_{alias}_hits")))


# ----------------------------------------------------------------------------- approximate


def _lsh_keys(planes: np.ndarray, id_col: str, vec_col: str, key_cols, tables: int, bits: int):
    """mapInArrow body: one output row per (input row, hash table) with the bucket id."""
    weights = (1 << np.arange(bits)).astype(np.int64)
    extra = list(key_cols) if key_cols else []

    def run(batches):
        for b in batches:
            valid, mat = _arrow_matrix(b.column(vec_col))
            if not valid.any():
                continue
            idx = np.nonzero(valid)[0]
            signs = (mat @ planes.reshape(tables * bits, -1).T) > 0          # (n, tables*bits)
            buckets = (signs.reshape(len(idx), tables, bits) * weights).sum(axis=2)  # (n, tables)
            take = pa.array(np.repeat(idx, tables))
            cols = [b.column(id_col).take(take), b.column(vec_col).take(take)]
            cols += [b.column(x).take(take) for x in extra]
            cols += [pa.array(np.tile(np.arange(tables, dtype=np.int64), len(idx))),
                     pa.array(buckets.reshape(-1).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, vec_col, *extra, "_t", "_b"])
    return run


def _plan_lsh(q: DataFrame, c: DataFrame, k: int, exclude_self: bool, key_q, key_c,
              tables: int = 8, bits: int = 8, seed: int = 17, block_rows: int = 50_000) -> DataFrame:
    """Approximate top-k: random-hyperplane hashing into ``tables`` x 2**``bits`` buckets.

    A query is compared with the corpus rows sharing one of its buckets; scores are exact
    for what is returned, recall depends on the data and the parameters. Bucket sizes are
    counted (at most ``tables * 2**bits`` rows reach the driver) and a bucket larger than
    ``block_rows`` on either side is cut into salted sub-blocks, the other side being
    copied to each, so no group exceeds ``block_rows`` rows per side however skewed the
    buckets are. Each group emits only its local top-k.
    """
    spark = q.sparkSession
    _, d = _size_of(c, "_cvec")
    planes = np.random.default_rng(seed).standard_normal((tables, bits, max(d, 1)))
    qs = q.mapInArrow(_lsh_keys(planes, "_qid", "_qvec", key_q, tables, bits),
                      _lsh_schema(q, key_q, "_qid", "_qvec"))
    cs = c.mapInArrow(_lsh_keys(planes, "_cid", "_cvec", key_c, tables, bits),
                      _lsh_schema(c, key_c, "_cid", "_cvec"))
    nq = {(r["_t"], r["_b"]): r["n"] for r in qs.groupBy("_t", "_b").agg(F.count(F.lit(1)).alias("n")).collect()}
    nc = {(r["_t"], r["_b"]): r["n"] for r in cs.groupBy("_t", "_b").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = [(t, b, max(1, math.ceil(nq.get((t, b), 0) / block_rows)), max(1, math.ceil(n / block_rows)))
             for (t, b), n in nc.items()]
    if not salts:
        return spark.createDataFrame([], HITS_SCHEMA)
    sal = F.broadcast(spark.createDataFrame(salts, "_t long, _b long, _sq long, _sc long"))
    qx = (qs.join(sal, ["_t", "_b"])
          .withColumn("_rq", F.pmod(F.xxhash64("_qid"), F.col("_sq")))
          .withColumn("_rc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_sc") - 1)))
          .drop("_sq", "_sc"))
    cx = (cs.join(sal, ["_t", "_b"])
          .withColumn("_rc", F.pmod(F.xxhash64("_cid"), F.col("_sc")))
          .withColumn("_rq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_sq") - 1)))
          .drop("_sq", "_sc"))

    keys = ["_t", "_b", "_rq", "_rc"]
    partial = qx.groupBy(*keys).cogroup(cx.groupBy(*keys)).applyInArrow(_met(k, exclude_self, key_q, key_c), HITS_SCHEMA)
    # The same pair can be found through several tables (same score): keep it once.
    once = partial.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return _merge_partial(once.withColumn("rank", F.lit(0).cast("long")), k)


def _lsh_schema(df: DataFrame, key_cols, id_col: str, vec_col: str) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cols = [f"{id_col} {types[id_col]}", f"{vec_col} {types[vec_col]}"]
    cols += [f"{x} {types[x]}" for x in (key_cols or [])]
    return ", ".join(cols + ["_t long", "_b long"])
