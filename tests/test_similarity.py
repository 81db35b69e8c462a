import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.similarity import _best_of, similarity_topk

SF = "/root/testdata/sf0.01"


def _brute(q, c, k, exclude_self=False, asof=False):
    out = {}
    for qi, qv, qr, qo in q:
        cand = []
        for ci, cv, cr, co in c:
            if exclude_self and ci == qi:
                continue
            if asof and not ((cr, co) < (qr, qo)):
                continue
            cand.append((-float(np.dot(np.asarray(qv, np.float64), np.asarray(cv, np.float64))), ci))
        cand.sort()
        out[qi] = [(ci, round(-s, 9)) for s, ci in cand[:k]]
    return out


def _as_dict(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
    return out


@pytest.fixture(scope="module")
def vecs(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").cast("long").alias("run"),
        F.col("vec_id").alias("ord"))
    rows = [(r["id"], r["embedding"], r["run"], r["ord"]) for r in e.collect()]
    return e, rows


@pytest.mark.parametrize("strategy", ["broadcast_corpus", "broadcast_queries", "blocked", "cells"])
def test_strategies_equal_brute_force(spark, vecs, strategy):
    e, rows = vecs
    got = similarity_topk(e, e, 5, query_id="id", corpus_id="id", exclude_self=True, strategy=strategy,
                          block_bytes=20_000)
    assert _as_dict(got) == _brute(rows, rows, 5, exclude_self=True)


@pytest.mark.parametrize("strategy", ["broadcast_corpus", "broadcast_queries", "blocked", "cells", "ranges"])
def test_asof_equal_brute_force(spark, vecs, strategy):
    e, rows = vecs
    got = similarity_topk(e, e, 3, query_id="id", corpus_id="id", strategy=strategy, block_bytes=20_000,
                          asof=(("run", "ord"), ("run", "ord")))
    want = _brute(rows, rows, 3, asof=True)
    assert _as_dict(got) == {k: v for k, v in want.items() if v}


def test_k_clamped_and_empty_corpus(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    c = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.6, 0.8])], "id long, embedding array<float>")
    got = _as_dict(similarity_topk(q, c, 5, query_id="id", corpus_id="id"))
    assert [i for i, _ in got[1]] == [10, 11] and [i for i, _ in got[2]] == [11, 10]
    empty = c.filter("id < 0")
    assert similarity_topk(q, empty, 5, query_id="id", corpus_id="id").count() == 0


def test_ties_by_smaller_id(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>")
    c = spark.createDataFrame([(i, [1.0, 0.0]) for i in (7, 3, 9, 5)], "id long, embedding array<float>")
    got = _as_dict(similarity_topk(q, c, 2, query_id="id", corpus_id="id"))
    assert [i for i, _ in got[1]] == [3, 5]


def test_broadcast_bound_is_enforced(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>")
    with pytest.raises(ValueError):
        similarity_topk(q, q, 1, query_id="id", corpus_id="id", strategy="broadcast_corpus",
                        broadcast_limit_bytes=1).count()


def test_auto_picks_blocked_beyond_bound(spark, vecs):
    e, rows = vecs
    got = similarity_topk(e, e, 2, query_id="id", corpus_id="id", exclude_self=True,
                          broadcast_limit_bytes=1000, block_bytes=50_000)
    assert _as_dict(got) == _brute(rows, rows, 2, exclude_self=True)


def test_approx_lsh_scores_exact_and_salting_invariant(spark, vecs):
    e, rows = vecs
    exact = _brute(rows, rows, 5, exclude_self=True)
    a = _as_dict(similarity_topk(e, e, 5, query_id="id", corpus_id="id", exclude_self=True,
                                 strategy="approx_lsh", lsh={"tables": 8, "bits": 4}))
    b = _as_dict(similarity_topk(e, e, 5, query_id="id", corpus_id="id", exclude_self=True,
                                 strategy="approx_lsh", lsh={"tables": 8, "bits": 4, "block_rows": 7}))
    assert a == b                                   # hot-bucket salting changes nothing
    vec = {r[0]: np.asarray(r[1], np.float64) for r in rows}
    hit = total = 0
    for qid, lst in a.items():
        scores = [s for _, s in lst]
        assert scores == sorted(scores, reverse=True) and len(lst) <= 5
        for cid, s in lst:
            assert cid != qid and abs(s - round(float(vec[qid] @ vec[cid]), 9)) < 1e-9
        want = {i for i, _ in exact[qid]}
        hit += len(want & {i for i, _ in lst})
        total += len(want)
    assert hit / total > 0.5                        # measured recall of this setting


def test_auto_broadcasts_queries_when_only_they_fit(spark, vecs):
    e, rows = vecs
    q = e.filter("id < 20")
    got = similarity_topk(q, e, 3, query_id="id", corpus_id="id", broadcast_limit_bytes=20 * 600)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "MapInArrow" in plan
    qrows = [r for r in rows if r[0] < 20]
    assert _as_dict(got) == _brute(qrows, rows, 3)


def test_broadcast_queries_over_many_batches(spark, vecs):
    e, rows = vecs
    q = e.filter("id < 20")
    qrows = [r for r in rows if r[0] < 20]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for asof in (False, True):
            got = similarity_topk(q, e, 3, query_id="id", corpus_id="id", strategy="broadcast_queries",
                                  asof=(("run", "ord"), ("run", "ord")) if asof else None)
            want = _brute(qrows, rows, 3, asof=asof)
            assert _as_dict(got) == {k: v for k, v in want.items() if v}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_running_best_keeps_k_rows_per_query():
    best = None
    rng = np.random.default_rng(3)
    every = []
    for batch in range(10):
        qid = np.repeat(np.arange(4), 3)
        cid = rng.permutation(12) + 100 * batch
        score = rng.integers(0, 5, 12).astype(float)
        every += list(zip(qid.tolist(), (-score).tolist(), cid.tolist()))
        best = _best_of(best, (qid, np.tile(np.arange(1, 4), 4), cid, score), 3)
        assert len(best[0]) == 12
    got = list(zip(best[0].tolist(), (-best[3]).tolist(), best[2].tolist()))
    assert got == [r for i in range(4) for r in sorted(x for x in every if x[0] == i)[:3]]
    assert best[1].tolist() == [1, 2, 3] * 4


def test_spread_only_when_narrow(spark):
    from tessera.session import spread
    wide = spark.range(0, 100, numPartitions=spark.sparkContext.defaultParallelism)
    assert spread(wide) is wide
    narrow = spark.range(0, 100, numPartitions=1)
    assert spread(narrow).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_cells_meet_fewer_pairs(spark):
    """Clustered vectors, ties, copies, a zero vector and null ones: as by brute force, and most pairs
    of queries and rows never meet."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16)) * 4
    vecs = np.concatenate([c + rng.standard_normal((25, 16)) * 0.1 for c in centres] + [np.repeat(centres[:1], 60, 0), np.zeros((1, 16))]).round(3)
    rows = [(i, [float(x) for x in v], 0, 0) for i, v in enumerate(vecs.astype(np.float32))]
    e = spark.createDataFrame([(i, v) for i, v, *_ in rows] + [(9001, None), (9002, [])], "id long, embedding array<float>").repartition(4)
    q = e.where("id % 7 = 0")
    stats = {}
    got = similarity_topk(q, e, 4, query_id="id", corpus_id="id", exclude_self=True, strategy="cells", block_bytes=20_000, cells={"cell_rows": 8}, stats=stats)
    want = _brute([r for r in rows if r[0] % 7 == 0], rows, 4, exclude_self=True)
    assert _as_dict(got) == want
    whole = sum(r[0] % 7 == 0 for r in rows) * len(rows)
    assert stats["first_pairs"] + stats["second_pairs"] < whole / 4
    none = similarity_topk(q, e.where("false"), 4, query_id="id", corpus_id="id", strategy="cells")
    assert none.collect() == []


@pytest.mark.parametrize("asof", [False, True])
def test_cells_copy_a_query_once_a_group(spark, vecs, monkeypatch, asof):
    """On vectors without clusters, where most cells are visited, a query is sent to a group of cells once (before:
    to each cell), in turns of bounded size, and only hits stay in the checkpoint folder."""
    import os
    from tessera.operators import similarity_cells
    e, rows = vecs
    stats = {}
    monkeypatch.setattr(similarity_cells, "TURN_ROWS", 1)
    monkeypatch.setattr(similarity_cells, "SPREAD_BYTES", 1)
    monkeypatch.setattr(similarity_cells, "_GATHERED", 50)
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    old = set(os.listdir(base))
    key = (("run", "ord"), ("run", "ord")) if asof else None
    got = similarity_topk(e, e, 4, query_id="id", corpus_id="id", exclude_self=not asof, asof=key, strategy="cells", block_bytes=60_000, cells={"cell_rows": 4}, stats=stats)
    assert _as_dict(got) == {q: x for q, x in _brute(rows, rows, 4, exclude_self=not asof, asof=asof).items() if x}
    assert stats["second_most"] < 4 * len(rows)
    left = {f.rsplit("-", 1)[0] for f in set(os.listdir(base)) - old}
    assert left <= {"cells-hits", "cells-second-hits"}


def test_ranges_meet_only_what_comes_before(spark, vecs):
    """Ranges above a query's key never meet it; a key that a third of the rows share is cut into parts."""
    e, rows = vecs
    stats = {}
    asof = (("run", "ord"), ("run", "ord"))
    got = similarity_topk(e, e, 3, query_id="id", corpus_id="id", strategy="ranges", block_bytes=10_000, asof=asof, stats=stats)
    assert _as_dict(got) == {k: v for k, v in _brute(rows, rows, 3, asof=True).items() if v}
    assert stats["ranges_pairs"] < 0.62 * len(rows) ** 2
    hot = e.withColumn("ord", F.expr("if(id % 3 = 0, 7, ord)")).withColumn("run", F.expr("if(id % 3 = 0, 1, run)"))
    hot_rows = [(i, v, 1 if i % 3 == 0 else r, 7 if i % 3 == 0 else o) for i, v, r, o in rows]
    got = similarity_topk(hot, hot, 3, query_id="id", corpus_id="id", strategy="ranges", block_bytes=10_000, asof=asof)
    assert _as_dict(got) == {k: v for k, v in _brute(hot_rows, hot_rows, 3, asof=True).items() if v}
    with pytest.raises(ValueError):
        similarity_topk(e, e, 3, query_id="id", corpus_id="id", strategy="ranges")


@pytest.mark.parametrize("strategy", ["broadcast_corpus", "broadcast_queries"])
def test_many_equal_vectors(spark, strategy):
    """Equal vectors are scored once; ties still go to the smaller ids, and a query never finds itself."""
    kinds = [[1.0, 0.0, 0.0], [0.5, 0.75, 0.0], [0.0, 0.0, 1.0], [-0.0, 0.0, 1.0]]
    rows = [(i * 7 % 500, kinds[i % 4], 0, 0) for i in range(500)]
    e = spark.createDataFrame([(i, v) for i, v, *_ in rows], "id long, embedding array<float>").repartition(3)
    for k, own in ((5, True), (5, False), (400, True)):
        got = similarity_topk(e, e, k, query_id="id", corpus_id="id", exclude_self=own, strategy=strategy)
        assert _as_dict(got) == _brute(rows, rows, k, exclude_self=own)


def test_rows_of_equal_vectors_beyond_the_bound_are_few(spark):
    """Above the broadcast bound a corpus of few different vectors is cut to the rows that count, and
    results are those of brute force; without that, every block would meet every query."""
    rng = np.random.default_rng(3)
    kinds = rng.standard_normal((6, 4)).astype(np.float32)
    n = 400
    ids = rng.permutation(n)
    rows = [(int(i), [float(x) for x in kinds[j % 6]], int(r), int(o))
            for j, (i, r, o) in enumerate(zip(ids, rng.integers(0, 3, n), rng.integers(0, 50, n)))]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, run long, ord long").repartition(5)
    limit = 200 * 60  # of 400 rows of 56 bytes
    key = (("run", "ord"), ("run", "ord"))
    for asof in (None, key):
        stats = {}
        got = similarity_topk(df, df, 3, query_id="id", corpus_id="id", exclude_self=True, asof=asof,
                              broadcast_limit_bytes=limit, stats=stats)
        want = _brute(rows, rows, 3, exclude_self=True, asof=asof is not None)
        assert _as_dict(got) == {q: x for q, x in want.items() if x}
        assert not stats  # neither cells nor ranges: what is left of the corpus is broadcast


def test_pruning_keeps_rows_without_vector_id_or_key(spark):
    from tessera.operators.similarity import _without_hopeless
    rows = [(i, [1.0, 0.0], 1, i) for i in range(50)] + [(None, [1.0, 0.0], 1, 1), (60, None, 1, 1), (61, [], 1, 1), (62, [1.0, -0.0], None, 1)]
    c = spark.createDataFrame(rows, "_cid long, _cvec array<float>, _crun long, _cord long")
    got = {r["_cid"] for r in _without_hopeless(c, 2, ("_crun", "_cord"), seen_bytes=500).collect()}
    assert {0, 1, 2, None, 60, 61, 62} <= got and len(got) < 40


def test_copies_per_query_stop_growing_with_the_table(spark):
    """A query goes to at most ``MAX_RANGES`` ranges, however small the blocks asked for."""
    from tessera.operators.similarity_cells import MAX_RANGES
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v], 0, i) for i, v in enumerate(rng.standard_normal((600, 3)).astype(np.float32))]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, run long, ord long")
    stats, asof = {}, (("run", "ord"), ("run", "ord"))
    got = similarity_topk(df, df, 3, query_id="id", corpus_id="id", strategy="ranges", block_bytes=5 * 48, asof=asof, stats=stats)
    want = _brute(rows, rows, 3, asof=True)
    assert _as_dict(got) == {q: x for q, x in want.items() if x}
    assert stats["ranges_copies"] <= 4 * MAX_RANGES * len(rows)


def test_ranking_by_column_chunks(spark, monkeypatch):
    """Chunks of few columns give the hits of one chunk, ties by smaller id included."""
    from tessera.operators import similarity as s
    rng = np.random.default_rng(9)
    mat = rng.integers(-2, 3, (300, 3)).astype(float)
    side = s._Side(rng.permutation(300).astype(np.int64), mat, None)
    want = s._score_and_rank(side, side, 4, True)
    monkeypatch.setattr(s, "_SCORE_COLUMNS", 16)
    monkeypatch.setattr(s, "_MAX_SCORE_CELLS", 16 * 50)
    got = s._score_and_rank(side, side, 4, True)
    assert all(np.array_equal(a, b) for a, b in zip(got, want))
