"""Bounded SQL repair over a table of candidate fixes.

Input: repair jobs ``(id, nlq, broken_sql)`` and candidates ``(id, iteration, text)`` (the
model's successive answers, recorded or produced round by round). Rules per job, over
iterations ``1..max_iterations`` in order:

* the candidate is cleaned of code fences;
* exactly ``GIVE_UP`` ends the job: no SQL, not successful;
* a valid statement ends the job successfully;
* anything else is logged with its validation error and the next iteration is tried;
* when none ended the job, the last candidate is returned, not successful, with a final
  history line; without any candidate (or ``max_iterations <= 0``) the input is returned
  with zero iterations.

Every group holds at most ``max_iterations`` rows, so the ordered collects are bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sqltext import strip_fences, with_validation

GIVE_UP = "GIVE_UP"

# History lines (fixed values: wording of the repair log).
LINE_GAVE_UP = "iteration %d: agent gave up"
LINE_FIXED = "iteration %d: fixed SQL validated successfully"
LINE_INVALID = "iteration %d: candidate SQL still invalid — %s"
LINE_EXHAUSTED = "max iterations (%d) reached without a valid fix"


def judged_candidates(jobs: DataFrame, candidates: DataFrame, max_iterations: int = 3) -> DataFrame:
    """Candidates of the jobs within the bound, cleaned, validated and classified."""
    # Hash-partition by job id: the per-job aggregates below reuse this partitioning, and the
    # validation runs in its own code-generated stage, on candidates that a job needs only.
    c = (candidates.filter((F.col("iteration") >= 1) & (F.col("iteration") <= max_iterations))
         .join(jobs.select("id"), "id", "left_semi")
         .repartition("id")
         .withColumn("clean", strip_fences("text")))
    c = with_validation(c, "clean", "v")
    kind = (F.when(F.col("clean") == GIVE_UP, F.lit("give_up"))
            .when(F.col("v_valid"), F.lit("fixed")).otherwise(F.lit("invalid")))
    line = (F.when(kind == "give_up", F.format_string(LINE_GAVE_UP, "iteration"))
            .when(kind == "fixed", F.format_string(LINE_FIXED, "iteration"))
            .otherwise(F.format_string(LINE_INVALID, "iteration", "v_reason")))
    return c.withColumn("kind", kind).withColumn("line", line)


def repair_history(jobs: DataFrame, candidates: DataFrame, max_iterations: int = 3) -> DataFrame:
    """History lines per job: ``(id, step, line)``, up to the first terminal iteration, and
    the exhaustion line when no iteration ended the job.

    One pass: windows over the id-partitioned candidates find the first terminal and the
    last iteration of each job; the last line of an exhausted job expands into two rows.
    """
    w = Window.partitionBy("id")
    j = (judged_candidates(jobs, candidates, max_iterations)
         .withColumn("t", F.min(F.when(F.col("kind") != "invalid", F.col("iteration"))).over(w))
         .withColumn("last", F.max("iteration").over(w)))
    kept = j.filter(F.col("t").isNull() | (F.col("iteration") <= F.col("t")))
    own = F.struct(F.col("iteration").cast("long").alias("step"), F.col("line").alias("line"))
    done = F.struct((F.col("iteration") + 1).cast("long").alias("step"),
                    F.lit(LINE_EXHAUSTED % max_iterations).alias("line"))
    rows = F.when(F.col("t").isNull() & (F.col("iteration") == F.col("last")), F.array(own, done)) \
        .otherwise(F.array(own))
    return kept.select("id", F.explode(rows).alias("h")).select("id", "h.step", "h.line")


def repair_outcome(jobs: DataFrame, candidates: DataFrame, max_iterations: int = 3) -> DataFrame:
    """``(id, fixed_sql, success, iterations)`` per job."""
    j = judged_candidates(jobs, candidates, max_iterations)
    per = j.groupBy("id").agg(
        F.min_by(F.struct("iteration", "kind", "clean"),
                 F.when(F.col("kind") != "invalid", F.col("iteration"))).alias("first_term"),
        F.count_if(F.col("kind") != "invalid").alias("n_term"),
        F.max_by(F.struct("iteration", "clean"), F.col("iteration")).alias("last"))
    out = jobs.select("id", "broken_sql").join(per, "id", "left")
    has_term = F.coalesce(F.col("n_term"), F.lit(0)) > 0
    fixed = (F.when(has_term & (F.col("first_term.kind") == "give_up"), F.lit(None).cast("string"))
             .when(has_term, F.col("first_term.clean"))
             .when(F.col("last").isNotNull(), F.col("last.clean"))
             .otherwise(F.col("broken_sql")))
    iters = (F.when(has_term, F.col("first_term.iteration"))
             .when(F.col("last").isNotNull(), F.col("last.iteration")).otherwise(F.lit(0)))
    success = has_term & (F.col("first_term.kind") == "fixed")
    return out.select("id", fixed.alias("fixed_sql"), success.alias("success"), iters.cast("long").alias("iterations"))


def _json_str(c):
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def repair_observations(jobs: DataFrame, candidates: DataFrame, max_iterations: int = 3) -> DataFrame:
    """Tool results as rows: the validation result of every candidate as JSON, and the
    critic prompt for an invalid one (question plus validation error; the broken SQL is
    both prediction and gold)."""
    from tessera.functions.prompts import critic_human
    j = judged_candidates(jobs, candidates, max_iterations).join(jobs.select("id", "nlq", "broken_sql"), "id")
    vjson = F.concat(F.lit('{"valid": '), F.when(F.col("v_valid"), F.lit("true")).otherwise(F.lit("false")),
                     F.lit(', "error": '), F.when(F.col("v_reason").isNull(), F.lit("null"))
                     .otherwise(_json_str(F.col("v_reason"))), F.lit("}"))
    nlq_err = F.when(F.col("v_reason").isNull(), F.col("nlq")).otherwise(
        F.concat(F.col("nlq"), F.lit("\n\nValidation error: "), F.col("v_reason")))
    return j.select("id", F.col("iteration").cast("long").alias("iteration"), vjson.alias("validation_json"),
                    F.when(F.col("kind") == "invalid", critic_human(nlq_err, "broken_sql", "broken_sql"))
                    .alias("critic_human"))
