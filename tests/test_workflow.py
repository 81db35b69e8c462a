import pytest

from tessera.operators import repair
from tessera.plans import workflow

ITEMS = "id long, embedding array<float>, run_id long, ordinal long, nlq string, gold_sql string"
CORPUS = "id long, embedding array<float>, nlq string, sql string"
RESP = "id long, call string, text string, error string, elapsed_ms double"
LESSONS = ("lesson_id long, run_id long, ordinal long, embedding array<float>, title string, trigger string, "
           "diagnosis string, fix_rule string, error_category string, example string")
GOLD = "SELECT COUNT(*) FROM orders"
WRONG = "SELECT COUNT(*) FROM customers"


def _items(spark, rows):
    return spark.createDataFrame([(i, v, 0, i, f"q{i}", GOLD) for i, v in rows], ITEMS)


def test_answer_gate_and_fallbacks(spark):
    items = _items(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 1.0])])
    corpus = spark.createDataFrame([(100, [1.0, 0.0], "ex", GOLD)], CORPUS)
    lessons = spark.createDataFrame([(900, 0, 0, [0.0, 1.0], "t", "g", "d", "f", "filter", "e")], LESSONS)
    resp = spark.createDataFrame([
        (1, "sql1", GOLD, None, 1.0),
        (2, "sql1", WRONG, None, 1.0), (2, "sql2", "```sql\n" + GOLD + "\n```", None, 1.0),
        (3, "sql1", "SELET 1", None, 1.0), (3, "sql2", GOLD, None, 1.0),
        (4, "sql1", None, "timeout", 1.0),
        (5, "sql1", WRONG, None, 1.0), (5, "sql2", None, "overloaded", 1.0),
    ], RESP)
    out = {r["question_id"]: r for r in workflow.answer_questions(
        spark, "", responses=resp, lessons=lessons, items=items, corpus=corpus).collect()}
    assert (out[1]["sql"], out[1]["confidence"], out[1]["used_lesson"]) == (GOLD, 1.0, False)
    assert (out[2]["sql"], out[2]["confidence"], out[2]["used_lesson"]) == (GOLD, 0.0, True)
    assert (out[3]["sql"], out[3]["confidence"], out[3]["used_lesson"]) == (GOLD, 1.0, True)
    assert (out[4]["sql"], out[4]["confidence"], out[4]["used_lesson"]) == ("", 0.0, False)
    assert (out[5]["sql"], out[5]["used_lesson"]) == (WRONG, True)


def test_eval_outcomes(spark):
    items = _items(spark, [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.8, 0.2]), (4, [0.7, 0.3])])
    lesson = '{"title": "t", "trigger": "g", "diagnosis": "d", "fix_rule": "f", "error_category": "filter", "example": "e"}'
    resp = spark.createDataFrame([
        (1, "sql1", GOLD, None, 10.0),                                   # pass@1
        (2, "sql1", WRONG, None, 10.0), (2, "sql2", GOLD, None, 10.0),   # pass@2
        (2, "critic", "1. wrong table", None, 1.0), (2, "lesson", lesson, None, 1.0),
        (3, "sql1", WRONG, None, 10.0), (3, "sql2", WRONG, None, 10.0),  # hard failure
        (3, "critic", None, "timeout", 1.0),                              # lesson error ignored
        (4, "sql1", None, "timeout", 10.0), (4, "sql2", GOLD, None, 10.0),
        (4, "critic", "x", None, 1.0), (4, "lesson", "no json", None, 1.0),
    ], RESP)
    out = {r["item_id"]: r for r in workflow.eval_attempts(spark, "", responses=resp, items=items).collect()}
    assert (out[1]["pass1"], out[1]["retried"], out[1]["sim2"], out[1]["pred_sql_2"]) == (True, False, None, None)
    assert (out[2]["pass1"], out[2]["pass2"], out[2]["hard_failure"]) == (False, True, False)
    assert out[2]["used_lesson_id"] == 2 and out[2]["had_lessons"] is False   # no earlier lesson
    assert (out[3]["pass2"], out[3]["hard_failure"], out[3]["used_lesson_id"]) == (False, True, None)
    assert out[3]["had_lessons"] is True and out[3]["sim2"] > 0              # sees item 2's lesson
    assert out[4]["pred_sql_1"] is None and out[4]["pass2"] is True and out[4]["used_lesson_id"] is None
    assert out[1]["latency_ms"] == 10.0 and out[2]["latency_ms"] == 22.0


def _repair(spark, cands, max_iterations=3):
    jobs = spark.createDataFrame([(1, "q", "SELET 1")], "id long, nlq string, broken_sql string")
    c = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(cands)], "id long, iteration int, text string")
    o = repair.repair_outcome(jobs, c, max_iterations).first()
    h = [r["line"] for r in repair.repair_history(jobs, c, max_iterations).orderBy("step").collect()]
    return (o["fixed_sql"], o["success"], o["iterations"]), h


def test_repair_rules(spark):
    assert _repair(spark, ["SELECT 1"])[0] == ("SELECT 1", True, 1)
    r, h = _repair(spark, ["SELET 1", "```sql\nSELECT 2\n```"])
    assert r == ("SELECT 2", True, 2)
    assert h[0].startswith("iteration 1: candidate SQL still invalid — SQL parse error")
    assert h[1] == "iteration 2: fixed SQL validated successfully"
    r, h = _repair(spark, ["SELET 1", "DROP TABLE x", "SELET 3"])
    assert r == ("SELET 3", False, 3) and h[-1] == "max iterations (3) reached without a valid fix"
    r, h = _repair(spark, ["SELET 1", "GIVE_UP", "SELECT 1"])
    assert r == (None, False, 2) and h[-1] == "iteration 2: agent gave up"
    assert _repair(spark, ["SELECT 1"], max_iterations=0)[0] == ("SELET 1", False, 0)


def test_csv_rules(spark, tmp_path):
    from tessera.sources.pairs import read_pairs_csv
    p = tmp_path / "a.csv"
    p.write_text('nlq,sql,extra\n  How many?  ," SELECT 1 ",x\n,SELECT 2,y\nNA,"SELECT\n3",z\nq4,,w\nq5,"   ",v\n')
    rows = sorted((r["nlq"], r["sql"]) for r in read_pairs_csv(spark, str(p)).collect())
    assert rows == sorted([("", "SELECT 2"), ("", "SELECT\n3"), ("How many?", "SELECT 1")])
    p2 = tmp_path / "b.csv"
    p2.write_text("sql\nSELECT 1\n")
    assert [(r["nlq"], r["sql"]) for r in read_pairs_csv(spark, str(p2)).collect()] == [("", "SELECT 1")]
    p3 = tmp_path / "c.csv"
    p3.write_text("nlq\nq\n")
    with pytest.raises(ValueError):
        read_pairs_csv(spark, str(p3))


def test_stream_ingest_is_idempotent(spark, tmp_path):
    from tessera.plans.ingest import RAW_SCHEMA
    from tessera.streaming.ingest import stream_ingest
    src = tmp_path / "src"
    src.mkdir()
    (src / "1.csv").write_text("pair_id,nlq,sql,note\n1,a,SELECT 1,\n2,a,SELECT 1,\n3,b,SELECT 2,\n")
    table = str(tmp_path / "t")
    stream_ingest(spark, str(src), table, str(tmp_path / "ck1"), RAW_SCHEMA, digits=1)
    t = stream_ingest(spark, str(src), table, str(tmp_path / "ck2"), RAW_SCHEMA, digits=1)
    rows = sorted((r["pair_id"], r["nlq"], r["sql"]) for r in t.rows().collect())
    assert rows == [(1, "a", "SELECT 1"), (3, "b", "SELECT 2")]


def test_many_micro_batches_give_the_same_table(spark, tmp_path):
    """One file a batch or all at once: the same pairs. A batch that is replayed, and a file that
    comes later, add what is new only."""
    from tessera.streaming.ingest import pairs_table, stream_ingest
    src = tmp_path / "src"
    src.mkdir()
    for f in range(5):
        (src / f"{f}.csv").write_text("nlq,sql\n" + "".join(f"q{(f * 3 + i) % 8},SELECT {(f * 3 + i) % 8}\n" for i in range(4)))
    one = stream_ingest(spark, str(src), str(tmp_path / "one"), str(tmp_path / "ck1"), digits=1)
    many = stream_ingest(spark, str(src), str(tmp_path / "many"), str(tmp_path / "ck2"), files_per_batch=1, digits=1)
    assert many.commits().count() == 5 and one.commits().count() == 1
    key = lambda t: sorted((r.nlq, r.sql, r.content_key) for r in t.rows().collect())
    assert key(one) == key(many) and len(key(one)) == 8
    (src / "9.csv").write_text("nlq,sql\nq1,SELECT 1\nnew,SELECT 9\n")
    later = stream_ingest(spark, str(src), str(tmp_path / "many"), str(tmp_path / "ck2"), files_per_batch=1, digits=1)
    assert later.commits().count() == 6 and len(key(later)) == 9
    assert len(key(pairs_table(spark, str(tmp_path / "many"), 1))) == 9


def test_stream_of_lessons(spark, tmp_path):
    import json

    from tessera.sources.corpus import lessons_table
    from tessera.streaming.ingest import stream_lessons
    lesson = json.dumps({"title": "t", "trigger": "date questions", "diagnosis": "d", "fix_rule": "f", "error_category": "filter", "example": "e"})
    src = tmp_path / "src"
    src.mkdir()
    (src / "1.json").write_text("".join(json.dumps({"id": i, "text": x}) + "\n" for i, x in enumerate([lesson, "Here: " + lesson, "none"])))
    (src / "2.json").write_text(json.dumps({"id": 7, "text": lesson.replace("date", "join")}) + "\n")
    t = lessons_table(spark, str(tmp_path / "t"), digits=1)
    for ck in ("a", "b"):
        stream_lessons(spark, str(src), t, str(tmp_path / ck), files_per_batch=1)
    rows = sorted((r.lesson_id, r.trigger, len(r.embedding)) for r in t.rows().collect())
    assert rows == [(0, "date questions", 64), (7, "join questions", 64)]


def test_eval_with_live_model(spark):
    items = _items(spark, [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.8, 0.2])])

    def factory():
        def fn(system, human, temperature):
            if "Generate a reusable lesson" in human:
                return ('{"title": "t", "trigger": "g", "diagnosis": "d", "fix_rule": "f", '
                        '"error_category": "filter", "example": "e"}')
            if "Identify the specific errors" in human:
                return "1. wrong table"
            # first attempts are wrong for question q2, retries are right
            if human.endswith("### Question\nq2") and temperature == 0.0:
                return "SELECT COUNT(*) FROM customers"
            return "```sql\nSELECT COUNT(*) FROM orders\n```"
        return fn

    out = {r["item_id"]: r for r in workflow.eval_attempts(spark, "", items=items, model_factory=factory).collect()}
    assert out[1]["pass1"] and out[3]["pass1"]
    assert (out[2]["pass1"], out[2]["pass2"], out[2]["used_lesson_id"]) == (False, True, 2)


def _written(spark):
    import os
    return set(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")))


def _turned(spark, monkeypatch, run):
    """The rows of a query in one turn and in three, with records broadcast and joined; and what kinds of files stay."""
    monkeypatch.setattr(workflow, "FEW_RECORDS", 1000)
    one = sorted(map(repr, run().collect()))
    old = _written(spark)
    for name, value in (("TURN_ITEMS", 1), ("MAX_TURNS", 3), ("FEW_RECORDS", 0)):
        monkeypatch.setattr(workflow, name, value)
    out = run()
    left = {f.rsplit("-", 1)[0] for f in _written(spark) - old}
    assert sorted(map(repr, out.collect())) == one
    return one, left


def test_evaluation_in_turns_leaves_its_rows_only(spark, monkeypatch):
    lesson = '{"title": "t", "trigger": "g", "diagnosis": "d", "fix_rule": "f", "error_category": "filter", "example": "e"}'
    items = _items(spark, [(i, [1.0, i / 10]) for i in [*range(12), 5]])
    resp = spark.createDataFrame([(i, c, t, None, 1.0) for i in range(12) for c, t in (
        ("sql1", WRONG if i % 2 else GOLD), ("sql2", GOLD), ("critic", "1. x"), ("lesson", lesson))], RESP)
    one, left = _turned(spark, monkeypatch, lambda: workflow.eval_attempts(spark, "", responses=resp, items=items))
    assert len(one) > 12 and left == {"attempts"}


def test_answers_in_turns_leave_their_rows_only(spark, monkeypatch):
    items = _items(spark, [(i, [1.0, i / 10]) for i in [*range(12), 5]])
    corpus = spark.createDataFrame([(100 + i, [1.0, i / 5], f"ex{i}", GOLD) for i in range(7)], CORPUS)
    lessons = spark.createDataFrame([(900, 0, 0, [0.0, 1.0], "t", "g", "d", "f", "filter", "e")], LESSONS)
    resp = spark.createDataFrame([(i, c, t, None, 1.0) for i in range(12) for c, t in (
        ("sql1", "SELET 1" if i % 2 else GOLD), ("sql2", GOLD))], RESP)
    one, left = _turned(spark, monkeypatch, lambda: workflow.answer_questions(
        spark, "", responses=resp, lessons=lessons, items=items, corpus=corpus))
    assert len(one) > 12 and left == {"answers"}
