import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as mt
from tessera.operators.split import cut_index, leakage_report, train_eval_split

ITEM_SCHEMA = ("run_id long, item_id long, pass1 boolean, pass2 boolean, hard_failure boolean, "
               "retried boolean, had_lessons boolean, sim1 double, sim2 double, latency_ms double")


def _items(spark, rows):
    return spark.createDataFrame(rows, ITEM_SCHEMA)


def _row(i, p1, p2, had=False, sim1=0.5, sim2=None, lat=100.0, run=1):
    retried = not p1
    if retried and sim2 is None:
        sim2 = 0.0
    return (run, i, p1, p2, (not p1 and not p2), retried, had and retried, sim1, sim2 if retried else None, lat)


def _metrics(spark, rows, runs=None):
    m = mt.eval_metrics(_items(spark, rows), by="run_id", runs=runs)
    return {r["run_id"]: r.asDict() for r in m.collect()}


def test_counts_and_rates(spark):
    rows = [_row(i, True, False) for i in range(7)] + [_row(7, False, True, had=True),
                                                       _row(8, False, True, had=True),
                                                       _row(9, False, False)]
    m = _metrics(spark, rows)[1]
    assert (m["total"], m["pass1_count"], m["pass2_count"], m["hard_failure_count"]) == (10, 7, 2, 1)
    assert m["overall_pass_rate"] == pytest.approx(0.9)
    assert m["kb_recovery_rate"] == pytest.approx(2 / 3)
    assert m["lesson_utilization"] == pytest.approx(2 / 3)


def test_recovery_when_nothing_failed_and_empty_run(spark):
    runs = spark.createDataFrame([(1,), (2,)], "run_id long")
    m = _metrics(spark, [_row(i, True, False) for i in range(3)], runs=runs)
    assert m[1]["kb_recovery_rate"] == 1.0
    assert m[1]["lesson_utilization"] == 0.0 and m[1]["avg_sim2"] == 0.0
    empty = m[2]
    assert empty["total"] == 0
    assert all(empty[c] == 0.0 for c in ("overall_pass_rate", "kb_recovery_rate", "lesson_utilization",
                                         "avg_sim1", "avg_sim2", "avg_latency_ms"))


def test_averages(spark):
    rows = [_row(0, False, False, had=True, sim1=0.9, sim2=0.6, lat=100.0),
            _row(1, False, False, had=False, sim1=0.8, lat=200.0),
            _row(2, False, True, had=True, sim1=0.7, sim2=0.9, lat=300.0),
            _row(3, True, False, sim1=0.8, lat=400.0)]
    m = _metrics(spark, rows)[1]
    assert m["avg_sim1"] == pytest.approx(0.8)
    assert m["avg_sim2"] == pytest.approx(0.5)      # retried without lessons counts as 0.0
    assert m["avg_latency_ms"] == pytest.approx(250.0)
    assert m["lesson_utilization"] == pytest.approx(2 / 3)


def test_report_and_json(spark):
    rows = [_row(i, True, False) for i in range(7)] + [_row(7, False, True), _row(8, False, True),
                                                       _row(9, False, False)]
    m = mt.eval_metrics(_items(spark, rows), by="run_id")
    rep = m.select(mt.format_report(m).alias("r")).first()["r"]
    assert "  pass@1:               7  (70.0%)" in rep
    assert "  KB recovery rate:     66.7%   (2 of 3 failures recovered)" in rep
    assert "  Avg latency:          100 ms" in rep
    import json
    j = json.loads(m.select(mt.metrics_json(m).alias("j")).first()["j"])
    assert list(j) == list(mt.METRIC_COLUMNS) and j["total"] == 10


def test_empty_report(spark):
    runs = spark.createDataFrame([(5,)], "run_id long")
    m = mt.eval_metrics(_items(spark, []), by="run_id", runs=runs)
    rep = m.select(mt.format_report(m).alias("r")).first()["r"]
    assert "  pass@1:               0\n" in rep and "  Overall pass rate:    0.0%" in rep


@pytest.mark.parametrize("n,train", [(100, 80), (2, 1), (25, 20), (3, 2)])
def test_split_sizes(spark, n, train):
    df = spark.range(n).withColumnRenamed("id", "pair_id")
    s = train_eval_split(df, "pair_id", digits=1)
    counts = {r["split"]: r["c"] for r in s.groupBy("split").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert counts == {"train": train, "eval": n - train}
    rep = leakage_report(s).first()
    assert rep["n_overlap"] == 0


def test_split_repeatable_and_matches_global_order(spark):
    df = spark.range(1000).withColumnRenamed("id", "pair_id")
    a = {r["pair_id"]: r["split"] for r in train_eval_split(df, "pair_id", digits=2).collect()}
    b = {r["pair_id"]: r["split"] for r in train_eval_split(df, "pair_id", digits=3).collect()}
    assert a == b
    import hashlib
    order = sorted(range(1000), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    expect = {i: ("train" if pos < 800 else "eval") for pos, i in enumerate(order)}
    assert a == expect


def test_split_too_small():
    with pytest.raises(ValueError):
        cut_index(1)
    with pytest.raises(ValueError):
        cut_index(0)


def test_split_refines_a_large_cut_bucket(spark):
    import hashlib
    df = spark.range(3000).withColumnRenamed("id", "pair_id")
    got = {r["pair_id"]: r["split"] for r in
           train_eval_split(df, "pair_id", digits=1, max_ranked_rows=20).collect()}
    order = sorted(range(3000), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert got == {i: ("train" if pos < 2400 else "eval") for pos, i in enumerate(order)}


def test_full_report_text(spark):
    rows = ([_row(i, True, False, sim1=0.812, lat=1243.0) for i in range(7)]
            + [_row(7 + i, False, i < 2, had=True, sim1=0.812, sim2=0.743, lat=1243.0) for i in range(3)])
    m = mt.eval_metrics(_items(spark, rows), by="run_id")
    rep = m.select(mt.format_report(m).alias("r")).first()["r"]
    heavy, light = "═" * 50, "  " + "─" * 46
    assert rep.split("\n") == [
        heavy, "  Evaluation Report", heavy,
        "  Total items:          10",
        "  pass@1:               7  (70.0%)",
        "  pass@2:               2  (20.0%)",
        "  Hard failures:        1  (10.0%)",
        "  Overall pass rate:    90.0%",
        light,
        "  KB recovery rate:     66.7%   (2 of 3 failures recovered)",
        "  Lesson utilization:   100.0%",
        light,
        "  Avg retrieval sim:    0.812",
        "  Avg lesson sim:       0.743",
        "  Avg latency:          1243 ms",
        heavy]
