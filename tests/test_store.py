import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators.similarity import similarity_topk
from tessera.sources.store import load_corpus, save_corpus, write_eval_results


def test_corpus_roundtrip_and_missing(spark, tmp_path):
    empty = load_corpus(spark, str(tmp_path / "none"), schemas.VECTORS)
    assert empty.count() == 0
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], schemas.VECTORS)
    q = spark.createDataFrame([(9, [0.6, 0.8])], schemas.VECTORS)
    before = [tuple(r) for r in similarity_topk(q, c, 2, query_id="id", corpus_id="id").collect()]
    save_corpus(c, str(tmp_path / "c"))
    back = load_corpus(spark, str(tmp_path / "c"), schemas.VECTORS)
    after = [tuple(r) for r in similarity_topk(q, back, 2, query_id="id", corpus_id="id").collect()]
    assert before == after
    assert similarity_topk(q, empty, 2, query_id="id", corpus_id="id").count() == 0


def test_eval_results_partitioned(spark, tmp_path):
    rows = [(i, i % 2, "q", "g", "p", None, True, False, False, None, None) for i in range(4)]
    df = spark.createDataFrame(rows, schemas.EVAL_RESULTS)
    write_eval_results(df, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r")).filter(F.col("training_run_id") == 1)
    assert back.count() == 2


def test_failed_run_keeps_error(spark, monkeypatch):
    from tessera.plans import training

    def boom(*a, **k):
        raise RuntimeError("no data")

    monkeypatch.setattr(training, "cycle_items", boom)
    events = []
    with pytest.raises(RuntimeError):
        training.training_cycle(spark, "/nowhere", run_id=7, events=events)
    ev = events[0].unionByName(events[1])
    last = training.latest_status(ev).first()
    assert last["status"] == "failed" and '"error": "no data"' in last["metrics"]


def test_add_examples_and_lessons(spark):
    import numpy as np
    from tessera.plans.records import add_examples, add_lessons
    cols = "pair_id long, nlq string, sql string, embedding array<float>"
    corpus = spark.createDataFrame([(1, "how many orders", "SELECT 1", [1.0, 0.0])], cols)
    batch = spark.createDataFrame([(2, "how many orders", "SELECT 1"), (3, "total revenue", "SELECT 2"),
                                   (4, "total revenue", "SELECT 2")], "pair_id long, nlq string, sql string")
    out = {r["pair_id"]: r for r in add_examples(corpus, batch).collect()}
    assert sorted(out) == [1, 3]                       # same content is not added twice
    assert abs(np.linalg.norm(out[3]["embedding"]) - 1) < 1e-5 and len(out[3]["embedding"]) == 64
    lcols = "lesson_id long, title string, trigger string, embedding array<float>"
    lc = spark.createDataFrame([], lcols)
    new = spark.createDataFrame([(7, "T", "questions about dates")], "lesson_id long, title string, trigger string")
    got = add_lessons(add_lessons(lc, new), new).collect()
    assert len(got) == 1 and abs(np.linalg.norm(got[0]["embedding"]) - 1) < 1e-5
