"""Live SQL repair: a bounded fixpoint over the jobs that are still open.

Every round asks a model once per open job, with the job's whole conversation so far, and commits the
answers before it uses them. An answer is either a call of tools or a candidate:

* tools: a JSON object ``{"tool_calls": [{"name": ..., "input": {...}}]}``. ``validate_sql`` gives the
  validator's verdict, ``analyze_errors`` asks the critic about the broken SQL and the error message,
  any other name gives an error. The results, as JSON, are the next message. A call of tools is no
  iteration;
* anything else is a candidate and an iteration: cleaned of fences; exactly ``GIVE_UP`` ends the job
  without SQL; a valid statement ends it; an invalid one is answered with its validation error.

Jobs leave the frontier in the round that ends them, so they are not asked again. A failed call ends its
job with the error. After ``max_iterations`` candidates the last one is returned, not successful.
``max_turns`` bounds the answers of a job, because tools could be called for ever.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import prompts as pr
from tessera.functions.sqltext import strip_fences, with_validation
from tessera.operators.model import NO_RECORD
from tessera.operators.repair import GIVE_UP, LINE_EXHAUSTED, LINE_FIXED, LINE_GAVE_UP, LINE_INVALID, _json_str

# Texts of the repair conversation that a model must see as they are.
FIRST_MESSAGE = "Fix this SQL for the question: %s\n\nBroken SQL:\n%s"
STILL_INVALID = "That SQL is still invalid: %s. Please fix it."
UNKNOWN_TOOL = "Unknown tool: %s"
LINE_TOOLS = "iteration %d: called tools [%s]"

SYSTEM = """You repair SQL queries that do not pass validation.
Call tools with a JSON object {"tool_calls": [{"name": ..., "input": {...}}]} and nothing else:
- validate_sql, input {"sql": ...}: the validator's verdict.
- analyze_errors, input {"broken_sql": ..., "error_message": ...}: a numbered list of mistakes.
Answer with the corrected SQL alone (SELECT or WITH only), or with GIVE_UP if it cannot be fixed."""
SAID, TOLD = "\n\n### Assistant\n", "\n\n### User\n"
TOO_MANY_TURNS = "no candidate after %d answers"

_CALLS = "struct<tool_calls:array<struct<name:string,input:map<string,string>>>>"

#: (id, turn, call, system, human, temperature) -> the same with text, error. call: "repair", or "critic"
#: with a column ``pos`` that tells the calls of a turn apart.
Ask = Callable[[DataFrame], DataFrame]


def _tool_results(turns: DataFrame, ask: Ask) -> DataFrame:
    """(id, results, names, error) of each job whose answer calls tools; results in the order of the calls,
    as many as one answer holds."""
    calls = turns.select("id", "turn", "nlq", F.posexplode("calls").alias("pos", "c")).select(
        "id", "turn", "nlq", "pos", F.col("c.name").alias("name"), F.col("c.input").alias("input")).checkpoint(eager=True)
    v = with_validation(calls.where("name = 'validate_sql'").withColumn("sql", F.col("input")["sql"]), "sql", "v")
    verdict = F.concat(F.lit('{"valid": '), F.col("v_valid").cast("string"), F.lit(', "error": '),
                       F.coalesce(_json_str(F.col("v_reason")), F.lit("null")), F.lit("}"))
    valid = v.select("id", "pos", "name", verdict.alias("result"), F.lit(None).cast("string").alias("error"))
    message, broken = F.coalesce(F.col("input")["error_message"], F.lit("")), F.coalesce(F.col("input")["broken_sql"], F.lit(""))
    told = F.when(message == "", F.col("nlq")).otherwise(F.concat("nlq", F.lit("\n\nValidation error: "), message))
    asked = ask(calls.where("name = 'analyze_errors'").select(
        "id", "turn", F.lit("critic").alias("call"), "pos", "name", F.lit(pr.CRITIC_SYSTEM).alias("system"),
        pr.critic_human(told, broken, broken).alias("human"), F.lit(0.0).alias("temperature")))
    critic = asked.select("id", "pos", "name", F.concat(F.lit('{"errors": '), _json_str(F.col("text")), F.lit("}")).alias("result"), "error")
    other = calls.where("name is null or name not in ('validate_sql', 'analyze_errors')").select(
        "id", "pos", F.coalesce("name", F.lit("")).alias("name"),
        F.concat(F.lit('{"error": '), _json_str(F.format_string(UNKNOWN_TOOL, F.coalesce("name", F.lit("")))), F.lit("}")).alias("result"),
        F.lit(None).cast("string").alias("error"))
    every = valid.unionByName(critic).unionByName(other)
    per = every.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "result"))).alias("t"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error"))
    return per.select("id", F.array_join(F.transform("t", lambda t: t.result), "\n").alias("results"),
                      F.array_join(F.transform("t", lambda t: F.concat(F.lit("'"), t["name"], F.lit("'"))), ", ").alias("names"), "error")


def repair_rounds(jobs: DataFrame, ask: Ask, max_iterations: int = 3, max_turns: int | None = None) -> DataFrame:
    """(id, fixed_sql, success, iterations, turns, error, history) per job ``(id, nlq, broken_sql)``, ids
    being unique. ``turns``: how often the model was asked; ``history``: a line per turn, joined by
    newlines. Null questions and statements count as empty; further columns are ignored."""
    max_turns = max_turns or 4 * max(max_iterations, 1)
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("nlq", "broken_sql")}
    frontier = jobs.select("id", *[c.alias(k) for k, c in text.items()]).select(
        "*", F.lit(0).cast("long").alias("iterations"), F.lit(0).cast("long").alias("turn"), F.format_string(FIRST_MESSAGE, "nlq", "broken_sql").alias("human"),
        F.col("broken_sql").alias("candidate"), F.array().cast("array<string>").alias("history"))
    done = []

    def ended(df: DataFrame, fixed, success: bool, error=None, line=None) -> None:
        history = F.col("history") if line is None else F.concat("history", F.array(line))
        done.append(df.select("id", fixed.alias("fixed_sql"), F.lit(success).alias("success"), "iterations", F.col("turn").alias("turns"),
                              (F.lit(None).cast("string") if error is None else error).alias("error"), F.array_join(history, "\n").alias("history")))

    if max_iterations <= 0:
        ended(frontier, F.col("broken_sql"), False, line=F.lit(LINE_EXHAUSTED % max_iterations))
        return done[0]
    frontier = frontier.checkpoint(eager=True)
    while not frontier.isEmpty():
        requests = frontier.select("id", F.col("turn") + 1, F.lit("repair"), F.lit(SYSTEM), "human", F.lit(0.0)).toDF(
            "id", "turn", "call", "system", "human", "temperature")
        answers = ask(requests).select("id", F.col("text").alias("answer"), F.col("error").alias("failed"))
        calls = F.from_json("answer", _CALLS)["tool_calls"]
        # The answers are committed here, before anything depends on them.
        now = frontier.join(answers, "id").withColumn("turn", F.col("turn") + 1) \
            .withColumn("calls", F.when(F.col("failed").isNull() & (F.size(calls) > 0), calls)).checkpoint(eager=True)
        ended(now.where("failed is not null"), F.lit(None).cast("string"), False, F.col("failed"))
        open_ = now.where("failed is null").drop("failed")

        tools = open_.where("calls is not null")
        answered = tools.join(_tool_results(tools, ask), "id").checkpoint(eager=True)
        ended(answered.where("error is not null"), F.lit(None).cast("string"), False, F.col("error"))
        called = answered.where("error is null").withColumn("history", F.concat("history", F.array(F.format_string(LINE_TOOLS, F.col("iterations") + 1, "names")))) \
            .withColumn("human", F.concat("human", F.lit(SAID), "answer", F.lit(TOLD), "results"))

        tried = open_.where("calls is null").withColumn("iterations", F.col("iterations") + 1).withColumn("candidate", strip_fences("answer"))
        tried = with_validation(tried, "candidate", "v").checkpoint(eager=True)
        gave_up = F.col("candidate") == GIVE_UP
        ended(tried.where(gave_up), F.lit(None).cast("string"), False, line=F.format_string(LINE_GAVE_UP, "iterations"))
        ended(tried.where(~gave_up & F.col("v_valid")), F.col("candidate"), True, line=F.format_string(LINE_FIXED, "iterations"))
        wrong = tried.where(~gave_up & ~F.col("v_valid")).withColumn("history", F.concat("history", F.array(F.format_string(LINE_INVALID, "iterations", "v_reason")))) \
            .withColumn("human", F.concat("human", F.lit(SAID), "candidate", F.lit(TOLD), F.format_string(STILL_INVALID, "v_reason")))

        state = called.select(*frontier.columns).unionByName(wrong.select(*frontier.columns)).checkpoint(eager=True)
        spent = F.col("iterations") >= max_iterations
        ended(state.where(spent), F.col("candidate"), False, line=F.lit(LINE_EXHAUSTED % max_iterations))
        late = F.col("turn") >= max_turns
        ended(state.where(~spent & late), F.col("candidate"), False, F.lit(TOO_MANY_TURNS % max_turns))
        frontier = state.where(~spent & ~late)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def recorded_turns(turns: DataFrame, critic: DataFrame) -> Ask:
    """Answers from tables: ``turns`` (id, turn, text, error) and ``critic`` (id, text, error)."""
    def ask(requests: DataFrame) -> DataFrame:
        if "pos" in requests.columns:
            got = requests.join(critic.select("id", F.col("text").alias("_t"), F.col("error").alias("_e"), F.lit(True).alias("_hit")), "id", "left")
        else:
            got = requests.join(turns.select("id", "turn", F.col("text").alias("_t"), F.col("error").alias("_e"), F.lit(True).alias("_hit")), ["id", "turn"], "left")
        return got.withColumn("text", F.col("_t")).withColumn("error", F.when(F.col("_hit").isNull(), F.lit(NO_RECORD)).otherwise(F.col("_e"))).drop("_t", "_e", "_hit")

    return ask


def stored_turns(store, fn_factory, **options) -> Ask:
    """Answers of a live model behind an ``AnswerStore``: a job that is repaired again asks nothing."""
    return lambda requests: store.ask(requests, fn_factory, **options)
