"""Live repair, round by round, with a model that answers by its prompt."""

import json

from tessera.operators import repair
from tessera.operators.answers import AnswerStore
from tessera.operators.repair_rounds import repair_rounds, recorded_turns, stored_turns

JOBS = "id long, nlq string, broken_sql string"
TURNS = "id long, turn long, text string, error string"
CRITIC = "id long, text string, error string"


def tools(*calls):
    return json.dumps({"tool_calls": [{"name": n, "input": i} for n, i in calls]})


VALIDATE = ("validate_sql", {"sql": "SELET 1"})
ANALYZE = ("analyze_errors", {"broken_sql": "SELET 1", "error_message": "bad word"})


def run(spark, answers, critic=(), **options):
    jobs = spark.createDataFrame([(i, f"q{i}", "SELET 1") for i in answers], JOBS)
    turns = spark.createDataFrame([(i, k + 1, a if not isinstance(a, Exception) else None, str(a) if isinstance(a, Exception) else None)
                                   for i, v in answers.items() for k, a in enumerate(v)], TURNS)
    rows = repair_rounds(jobs, recorded_turns(turns, spark.createDataFrame(list(critic), CRITIC)), **options).collect()
    assert len(rows) == len(answers)
    return {r.id: r for r in rows}


def test_rounds(spark):
    got = run(spark, {
        1: ["SELECT 1"], 2: ["```sql\nSELECT 2\n```"], 3: [tools(VALIDATE), "SELECT 3"], 4: [tools(VALIDATE, ANALYZE), tools(("drop_table", {"t": "x"})), "SELECT 4"],
        5: ["SELET 1", "SELECT 5"], 6: ["SELET a", "SELET b", "SELET c", "SELECT 6"], 7: ["SELET 1", "GIVE_UP", "SELECT 7"],
        8: [RuntimeError("overloaded")], 9: [tools(ANALYZE), "SELECT 9"], 10: [], 11: ["", "DROP TABLE t", "SELECT 1; SELECT 2"], 12: [tools((None, {})), "SELECT 12"],
        13: ['{"tool_calls": []}', '{"tool_calls": "x"}', "SELECT 13"]}, critic=[(4, "1. bad", None), (9, None, "busy")])
    brief = {i: (r.fixed_sql, r.success, r.iterations, r.turns, r.error) for i, r in got.items()}
    assert brief == {
        1: ("SELECT 1", True, 1, 1, None), 2: ("SELECT 2", True, 1, 1, None), 3: ("SELECT 3", True, 1, 2, None), 4: ("SELECT 4", True, 1, 3, None),
        5: ("SELECT 5", True, 2, 2, None), 6: ("SELET c", False, 3, 3, None), 7: (None, False, 2, 2, None), 8: (None, False, 0, 1, "overloaded"),
        9: (None, False, 0, 1, "busy"), 10: (None, False, 0, 1, "no recorded response"), 11: ("SELECT 1; SELECT 2", False, 3, 3, None),
        12: ("SELECT 12", True, 1, 2, None), 13: ("SELECT 13", True, 3, 3, None)}
    assert got[4].history.split("\n") == ["iteration 1: called tools ['validate_sql', 'analyze_errors']", "iteration 1: called tools ['drop_table']",
                                          "iteration 1: fixed SQL validated successfully"]
    assert got[6].history.split("\n")[-1] == "max iterations (3) reached without a valid fix" and len(got[6].history.split("\n")) == 4
    assert got[7].history.split("\n")[-1] == "iteration 2: agent gave up"


def test_bounds(spark):
    assert [(r.fixed_sql, r.iterations, r.turns) for r in run(spark, {1: ["SELECT 1"]}, max_iterations=0).values()] == [("SELET 1", 0, 0)]
    r = run(spark, {1: [tools(VALIDATE)] * 9}, max_iterations=1)[1]
    assert (r.success, r.iterations, r.turns, r.error) == (False, 0, 4, "no candidate after 4 answers")
    assert run(spark, {1: ["SELET 1", "SELECT 1"]}, max_iterations=1)[1].success is False


def test_same_as_the_candidate_table(spark):
    cands = {1: ["SELECT 1"], 2: ["SELET 1", "```\nSELECT 2\n```"], 3: ["x", "y", "z"], 4: ["SELET 1", "GIVE_UP"] + ["SELECT 1"]}
    jobs = spark.createDataFrame([(i, "q", "SELET 1") for i in cands], JOBS)
    c = spark.createDataFrame([(i, k + 1, t) for i, v in cands.items() for k, t in enumerate(v)], "id long, iteration int, text string")
    old = {r.id: (r.fixed_sql, r.success, r.iterations) for r in repair.repair_outcome(jobs, c).collect()}
    assert {i: (r.fixed_sql, r.success, r.iterations) for i, r in run(spark, cands).items()} == old


def test_prompts_grow_and_stop(spark, tmp_path):
    """The last error and the tools' results are in the next prompt; a job that ended is not asked
    again; a second run asks nothing."""
    log, call = str(tmp_path / "log"), tools(ANALYZE, VALIDATE, ("x", {}))

    def factory():
        import json
        import os

        def fn(system, human, temperature):
            fd = os.open(log, os.O_WRONLY | os.O_APPEND | os.O_CREAT)
            os.write(fd, (json.dumps(human) + "\n").encode())
            os.close(fd)
            if "Identify the specific errors" in human:
                return "1. misspelt SELECT" if "Validation error: bad word" in human else "?"
            if "question: one" in human:
                return "SELECT 1"
            if "misspelt SELECT" in human:
                return "SELECT 2"
            if "is still invalid" in human:
                return call
            return "SELET 2"
        return fn

    jobs = spark.createDataFrame([(1, "one", "SELET 1"), (2, "two", "SELET 1"), (3, None, None)], JOBS)
    store = AnswerStore(spark, str(tmp_path / "answers"), digits=1)
    got = {r.id: (r.fixed_sql, r.success, r.iterations, r.turns) for r in repair_rounds(jobs, stored_turns(store, factory)).collect()}
    assert got == {1: ("SELECT 1", True, 1, 1), 2: ("SELECT 2", True, 2, 3), 3: ("SELECT 2", True, 2, 3)}
    prompts = [json.loads(x) for x in open(log)]
    assert len([p for p in prompts if "question: one" in p]) == 1
    last = max((p for p in prompts if "question: two" in p), key=len)
    assert "That SQL is still invalid: SQL parse error: unexpected token 'SELET'.. Please fix it." in last
    assert '{"errors": "1. misspelt SELECT"}' in last and '{"valid": false, "error": "SQL parse error' in last and '{"error": "Unknown tool: x"}' in last
    again = {r.id: (r.fixed_sql, r.success, r.iterations, r.turns) for r in repair_rounds(jobs, stored_turns(store, factory)).collect()}
    assert again == got and len(open(log).readlines()) == len(prompts)
