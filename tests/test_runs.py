"""Stored training runs: stages, resumption after a cut, corpora that grow from run to run."""

import json

import pytest

from tessera.plans import runs

PAIRS = "pair_id long, nlq string, sql string"
WORDS = ["orders", "customers", "parts", "revenue", "nations"]


def pairs(spark, low, high):
    return spark.createDataFrame([(i, "" if i % 7 == 3 else f"how many {WORDS[i % 5]} number {i}", f"SELECT COUNT(*) FROM {WORDS[i % 5]} WHERE k = {i}")
                                  for i in range(low, high)], PAIRS)


@pytest.fixture(scope="module")
def model(spark):
    """Recorded answers: the pair's own SQL, wrong at first for some, and an error for one question."""
    rows = []
    for i in range(60):
        gold = f"SELECT COUNT(*) FROM {WORDS[i % 5]} WHERE k = {i}"
        lesson = {"title": f"L{i}", "trigger": f"number {i}", "diagnosis": "d", "fix_rule": "f", "error_category": "filter", "example": "e"}
        rows += [(i, "sql1", "SELECT 1" if i % 3 == 0 else gold, None, 1.0), (i, "sql2", "SELECT 1" if i % 2 else gold, None, 1.0), (i, "critic", "1. wrong", None, 1.0),
                 (i, "lesson", json.dumps(lesson), None, 1.0), (i, "nlq", None if i == 10 else f"how many {WORDS[i % 5]} number {i}", "timeout" if i == 10 else None, 1.0)]
    return spark.createDataFrame(rows, "id long, call string, text string, error string, elapsed_ms double")


def test_a_run_that_was_cut_goes_on(spark, tmp_path, model, monkeypatch):
    """Cut at the end of a stage, after its table was written and before it was marked."""
    whole = runs.run_cycle(spark, pairs(spark, 0, 40), str(tmp_path / "whole"), 1, model, digits=1).collect()
    assert whole[0].n_train + whole[0].n_eval == 39 and whole[0].n_examples_after_backfill == 39 and whole[0].total == whole[0].n_eval
    path = str(tmp_path / "cut")
    log = runs.RunLog(spark, f"{path}/runs")
    event = runs.RunLog.event
    for name in ("results",):
        def dies(self, run_id, status, stage=None, detail=None):
            if stage == name:
                raise RuntimeError(f"lost in {name}")
            event(self, run_id, status, stage, detail)

        monkeypatch.setattr(runs.RunLog, "event", dies)
        with pytest.raises(RuntimeError):
            runs.run_cycle(spark, pairs(spark, 0, 40), path, 1, model, digits=1)
        monkeypatch.undo()
        assert [(r.status, json.loads(r.detail)) for r in log.status().collect()] == [("failed", {"error": f"lost in {name}"})]
        assert not log.has(1, name) and log.has(1, "pairs")
    assert runs.run_cycle(spark, pairs(spark, 0, 40), path, 1, model, digits=1).collect() == whole
    assert [r.status for r in log.status().collect()] == ["done"]


def test_corpora_grow_from_run_to_run(spark, tmp_path, model):
    path = str(tmp_path / "t")
    first = runs.run_cycle(spark, pairs(spark, 0, 30), path, 1, model, digits=1).first()
    second = runs.run_cycle(spark, pairs(spark, 20, 60), path, 2, model, digits=1).first()
    assert (first.n_examples_after_backfill, second.n_examples_after_backfill) == (29, 59)
    log = runs.RunLog(spark, f"{path}/runs")
    assert {(r.run_id, r.status) for r in log.status().collect()} == {(1, "done"), (2, "done")}
    results = log.table("results")
    assert {r.run: r["count"] for r in results.groupBy("run").count().collect()} == {1: first.n_eval, 2: second.n_eval}
    titles = {r.title for r in runs.lessons_table(spark, f"{path}/lessons", 1).rows().collect()}
    failed = {f"L{r.item_id}" for r in results.where("not pass1").collect()}
    assert titles == failed and titles
    # Items of the second run see lessons of the first; that of the first run that is first sees none.
    retried = results.where("run = 2 and retried").collect()
    assert retried and all(r.had_lessons for r in retried)
    again = runs.run_cycle(spark, pairs(spark, 20, 60), path, 2, model, digits=1).first()
    assert again == second and log.table("dropped").select("pair_id").collect() == [(10,)]


def test_no_pairs_is_an_error(spark, tmp_path, model):
    with pytest.raises(ValueError, match="No valid rows"):
        runs.run_cycle(spark, pairs(spark, 10, 11), str(tmp_path / "t"), 1, model, digits=1)
