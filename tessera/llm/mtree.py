"""Exact top-k search by inner product with M-trees, best first.

Vectors are scaled to whole numbers. With M no less than any norm, x' = (x, sqrt(M^2 - |x|^2)) and
q' = (q, 0), |q' - x'|^2 = |q|^2 + M^2 - 2 q.x: the best scores are the nearest neighbours, and
an M-tree, which needs a metric, can find them.

Rows are dealt to shards of bounded size by a hash of their id, so equal vectors spread like any
others. Each shard is one M-tree, kept as a table of pages: a pivot, a covering radius, the
distance to the parent's pivot, and in leaves the rows with their distance to the pivot.
Queries meet every shard in blocks. A query visits pages by their least possible distance; a
page or row whose stored distance to its pivot rules it out by the triangle inequality is never
visited. The queries of a block go step by step: each takes its next pages, in each step twice as
many as before, and those that take the same page are computed together. Each (query, shard) returns at most k rows, which a window merges.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tessera.llm.common import known, saved

#: Rows of a shard, fewer for long vectors (``SHARD_CELLS`` numbers); queries of a block.
SHARD_ROWS, SHARD_CELLS, BLOCK_QUERIES = 32768, 1 << 22, 8192
PAGE, FANOUT = 128, 8
#: Queries times pages that a task searches at a time.
CELLS = 1 << 21
#: Sums below this are exact in doubles.
EXACT = float(1 << 52)

_PAGES = ("shard int, page int, parent int, leaf boolean, radius double, to_parent double, pivot array<double>, "
          "ids array<long>, vectors array<double>, to_pivot array<double>")
_PAGES_ARROW = pa.schema([("shard", pa.int32()), ("page", pa.int32()), ("parent", pa.int32()), ("leaf", pa.bool_()),
                          ("radius", pa.float64()), ("to_parent", pa.float64()), ("pivot", pa.list_(pa.float64())),
                          ("ids", pa.list_(pa.int64())), ("vectors", pa.list_(pa.float64())), ("to_pivot", pa.list_(pa.float64()))])


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) with v as doubles. Rows with a null id, a null vector or a component that is
    null or not finite go."""
    v = known(embeddings, **{id_col: "long", vector_col: "array<double>"}).toDF("vec_id", "v")
    fine = "vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return v.where(fine)


def _lists(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, and the length of each, from Arrow's buffers."""
    return pc.list_flatten(col).to_numpy(), pc.list_value_length(col).to_numpy()


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows padded with zeros to ``dim``, scaled and floored."""
    values, sizes = _lists(col)
    out = np.zeros((len(col), dim))
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(col)), sizes), at] = values
    return np.floor(256 * out) + 0.0  # no negative zeros


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])


def _far(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - p) ** 2).sum(1))


class _Builder:
    """Bulk-loads one shard's tree into page rows."""

    def __init__(self, shard: int, ids: np.ndarray, x: np.ndarray, top: float):
        self.shard, self.ids, self.x, self.y, self.rows = shard, ids, x, _lifted(x, top), []
        todo = [(np.arange(len(ids)), -1, None)]
        while todo:
            todo += self._page(*todo.pop())

    def _page(self, rows: np.ndarray, parent: int, above: np.ndarray | None) -> list:
        y = self.y[rows]
        pivot = y[_far(y, y.mean(0)).argmin()]
        far = _far(y, pivot)
        leaf = len(rows) <= PAGE
        page = len(self.rows)
        held = rows if leaf else rows[:0]
        self.rows.append((self.shard, page, parent, leaf, float(far.max()), 0.0 if above is None else float(_far(pivot[None], above)[0]),
                          pivot, self.ids[held], self.x[held].ravel(), far if leaf else far[:0]))
        return [] if leaf else [(part, page, pivot) for part in self._split(rows, y, far)]

    def table(self) -> pa.Table:
        """The page rows."""
        columns = []
        for values, field in zip(zip(*self.rows), _PAGES_ARROW):
            if pa.types.is_list(field.type):
                ends = np.cumsum([0, *map(len, values)])
                values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), field.type.value_type))
            columns.append(values if isinstance(values, pa.Array) else pa.array(values, field.type))
        return pa.Table.from_arrays(columns, schema=_PAGES_ARROW)

    @staticmethod
    def _split(rows: np.ndarray, y: np.ndarray, far: np.ndarray) -> list[np.ndarray]:
        """Up to FANOUT parts around seeds that are far from each other; equal parts by distance
        if that leaves nearly all rows in one (many equal rows)."""
        near, owner = far.copy(), np.zeros(len(rows), int)
        for k in range(1, min(FANOUT, -(-len(rows) // PAGE))):
            d = _far(y, y[near.argmax()])
            owner[d < near] = k
            near = np.minimum(near, d)
        parts = [rows[owner == k] for k in range(owner.max() + 1)]
        parts = [p for p in parts if len(p)]
        if max(map(len, parts)) > 0.9 * len(rows):
            parts = np.array_split(rows[np.argsort(far, kind="stable")], 2)
        return parts


class _Tree:
    """A shard's pages as arrays."""

    def __init__(self, pages: pa.Table, dim: int):
        pages = pages.sort_by("page")
        self.parent = pages["parent"].to_numpy()
        self.leaf = pages["leaf"].to_numpy(zero_copy_only=False)
        self.radius, self.to_parent = pages["radius"].to_numpy(), pages["to_parent"].to_numpy()
        self.pivot = _lists(pages["pivot"])[0].reshape(len(self.parent), dim + 1)
        ids, sizes = _lists(pages["ids"])
        ends = np.cumsum(sizes)[:-1]
        self.ids, self.to_pivot = np.split(ids, ends), np.split(_lists(pages["to_pivot"])[0], ends)
        self.x = np.split(_lists(pages["vectors"])[0].reshape(-1, dim), ends)
        self.most = max((np.abs(x).max(initial=0) for x in self.x), default=0)
        by_parent = np.argsort(self.parent, kind="stable")
        pages_of = np.searchsorted(self.parent[by_parent], np.arange(len(self.parent) + 1))
        self.children = [by_parent[a:b] for a, b in zip(pages_of, pages_of[1:])]

    def search(self, q: np.ndarray, own: np.ndarray, k: int, top: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, vec_id, score) of the k best rows of each query."""
        out = []
        for at in np.array_split(np.arange(len(q)), -(-len(q) * len(self.parent) // CELLS)):
            if self.most * np.abs(q[at]).sum(1).max() < EXACT:
                out.append(self._together(q[at], own[at], k, top, at))
            else:
                one = [(i, v, s) for i in at for s, v in self.best(q[i], own[i], k, top)]
                out.append(tuple(np.array(c, np.int64) for c in zip(*one)) if one else (np.zeros(0, np.int64),) * 3)
        return tuple(np.concatenate(c) for c in zip(*out))

    def _together(self, q: np.ndarray, own: np.ndarray, k: int, top: float, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = (q * q).sum(1) + top
        slack = 4 * np.sqrt((q.shape[1] + 8) * np.finfo(float).eps * whole) + 1e-9  # doubles' error; bounds are never too tight
        scores, ids = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        limit = np.full(len(q), np.inf)
        far, least = np.zeros((len(q), len(self.parent))), np.full((len(q), len(self.parent)), np.inf)  # least: of pages to visit

        def visit(rows: np.ndarray, pages: np.ndarray, wanted: np.ndarray) -> None:
            """Distances of the rows to the pages, which are to be visited where wanted."""
            d = np.sqrt(np.maximum(whole[rows, None] - 2 * (q[rows] @ self.pivot[pages, :-1].T), 0))
            far[rows[:, None], pages], least[rows[:, None], pages] = d, np.where(wanted, d - self.radius[pages], np.inf)

        live, step = np.arange(len(q)), 1
        visit(live, np.zeros(1, int), np.ones((len(q), 1), bool))
        while True:
            bound = least[live]
            taken = (bound < np.inf) & (bound <= (limit + slack)[live, None])
            going = taken.any(1)
            live, bound, taken = live[going], bound[going], taken[going]
            if not len(live):
                break
            if step < bound.shape[1]:
                taken &= bound <= np.partition(bound, step - 1, 1)[:, step - 1:step]
            step, new = 2 * step, []
            for p in np.flatnonzero(taken.any(0)).tolist():
                rows = live[taken[:, p]]
                least[rows, p] = np.inf
                reach = (limit + slack)[rows, None]
                if not self.leaf[p]:
                    c = self.children[p]
                    wanted = np.abs(far[rows, p, None] - self.to_parent[c]) - self.radius[c] <= reach
                    some = wanted.any(0)
                    if some.any():
                        visit(rows, c[some], wanted[:, some])
                    continue
                may = (np.abs(far[rows, p, None] - self.to_pivot[p]) <= reach) & (self.ids[p] != own[rows, None])
                some = np.flatnonzero(may.any(0))
                s = q[rows] @ self.x[p][some].T
                i, j = np.nonzero(may[:, some] & (s >= scores[rows, -1:]))
                new.append((rows[i], s[i, j], self.ids[p][some[j]]))
            if new:
                self._merge(scores, ids, *(np.concatenate(c) for c in zip(*new)))
                limit = np.where(np.isfinite(scores[:, -1]), np.sqrt(np.maximum(whole - 2 * scores[:, -1], 0)), np.inf)
        i, j = np.nonzero(np.isfinite(scores))
        return names[i], ids[i, j], scores[i, j].astype(np.int64)

    @staticmethod
    def _merge(scores: np.ndarray, ids: np.ndarray, row: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        """Puts new candidates into the rows' best ones, which stay in order."""
        k = scores.shape[1]
        rows = np.unique(row)
        row = np.concatenate((np.repeat(rows, k), row))
        score, vec_id = np.concatenate((scores[rows].ravel(), score)), np.concatenate((ids[rows].ravel(), vec_id))
        order = np.lexsort((vec_id, -score, row))
        row, score, vec_id = row[order], score[order], vec_id[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        kept = nth < k
        scores[row[kept], nth[kept]], ids[row[kept], nth[kept]] = score[kept], vec_id[kept]

    def best(self, q: np.ndarray, own: int, k: int, top: float) -> list[tuple[int, int]]:
        """(score, vec_id) of the k best rows, by score and then the smaller id."""
        whole = float(q @ q) + top
        slack = 1e-7 * np.sqrt(whole) + 1e-9  # doubles' error; bounds are never too tight
        lifted = np.append(q, 0.0)
        found: list[tuple[int, int]] = []  # (score, -vec_id), a heap whose least is the worst kept
        limit = np.inf
        d = float(_far(self.pivot[:1], lifted)[0])
        queue = [(d - self.radius[0], 0, d)]
        while queue:
            least, page, d = heapq.heappop(queue)
            if least > limit + slack:
                break
            if not self.leaf[page]:
                c = self.children[page]
                c = c[np.abs(d - self.to_parent[c]) - self.radius[c] <= limit + slack]
                far = _far(self.pivot[c], lifted)
                for p, f, b in zip(c.tolist(), far.tolist(), (far - self.radius[c]).tolist()):
                    if b <= limit + slack:
                        heapq.heappush(queue, (b, p, f))
                continue
            may = np.flatnonzero((np.abs(d - self.to_pivot[page]) <= limit + slack) & (self.ids[page] != own))
            for score, vec_id in zip(_products(self.x[page][may], q), self.ids[page][may].tolist()):
                if len(found) < k:
                    heapq.heappush(found, (score, -vec_id))
                elif (score, -vec_id) > found[0]:
                    heapq.heapreplace(found, (score, -vec_id))
                else:
                    continue
                if len(found) == k:
                    limit = np.sqrt(max(0.0, whole - 2.0 * found[0][0]))
        return [(s, -v) for s, v in found]


def _products(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact whole inner products."""
    if not len(x):
        return []
    if np.abs(x).max() * np.abs(q).sum() < EXACT:
        return [int(s) for s in (x @ q).tolist()]
    q_ = [int(c) for c in q]
    return [sum(int(a) * b for a, b in zip(row, q_)) for row in x]


def build(vectors: DataFrame, dim: int, top: float, n_shards: int) -> DataFrame:
    """The page table, saved: (shard, page, parent, leaf, radius, to_parent, pivot, ids, vectors, to_pivot)."""

    def load(t: pa.Table) -> pa.Table:
        x, ids = _matrix(t["v"], dim), t["vec_id"].to_numpy()
        whole = np.hstack([x, ids.view(np.float64)[:, None]])
        _, first = np.unique(whole.view(np.dtype((np.void, whole.itemsize * whole.shape[1]))).ravel(), return_index=True)
        first.sort()  # rows equal in id and numbers are one
        return _Builder(t["shard"][0].as_py(), ids[first], x[first], top).table()

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int"))
    return saved(dealt.groupBy("shard").applyInArrow(load, _PAGES), "mtree-pages")


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, shard_rows: int = SHARD_ROWS,
          block_queries: int = BLOCK_QUERIES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id ``every`` divides.

    Candidates are all rows but those with the query's id. Ties go to the smaller id; fewer
    candidates give fewer rows. Rows with a null id, a null vector or a component that is null
    or not finite take no part; shorter vectors count as padded with zeros; rows equal in id and
    scaled vector are one; of rows that share an id only, each is a candidate, and as queries their
    best rows are merged. Further columns are ignored; an empty table gives no rows. A score
    beyond a long is an error.
    """
    v = usable(embeddings, id_col, vector_col)
    n, dim, top = v.agg(F.count("*"), F.max(F.size("v")),
                        F.max(F.expr("aggregate(v, 0d, (a, x) -> a + pow(256 * abs(x) + 1, 2))"))).first()
    dim, top = max(dim or 0, 1), float(top or 0)
    n_shards = -(-max(n, 1) // min(shard_rows, max(PAGE, SHARD_CELLS // dim)))
    pages = build(v, dim, top, n_shards)
    queries = v.where(F.col("vec_id") % every == 0)
    n_blocks = -(-max(queries.count(), 1) // block_queries)
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int")) \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    given = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64),) * 3
        if len(left) and len(right):
            own = left["vec_id"].to_numpy()
            row, vec_id, score = _Tree(right, dim).search(_matrix(left["v"], dim), own, k, top)
            found = own[row], vec_id, score
        return pa.table(list(map(pa.array, found)), ["query_id", "vec_id", "score"])

    found = asked.groupBy("shard", "block").cogroup(given.groupBy("shard", "block")) \
        .applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
