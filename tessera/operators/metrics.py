"""Evaluation metrics per run, the readable report and the JSON form.

Input: one row per evaluated item with ``pass1, pass2, hard_failure, retried, had_lessons``
flags, ``sim1`` (example retrieval confidence), ``sim2`` (lesson confidence; null when the
item was not retried, 0.0 when it was retried without lessons) and ``latency_ms``.

One grouped aggregate computes all ten metrics; Spark splits it into a partial aggregate
before the shuffle and a final one after, so only one row per run and partition moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRIC_COLUMNS = ("total", "pass1_count", "pass2_count", "hard_failure_count",
                  "overall_pass_rate", "kb_recovery_rate", "lesson_utilization",
                  "avg_sim1", "avg_sim2", "avg_latency_ms")


def _rates(total: Column, p1: Column, p2: Column, retried: Column, had: Column) -> list[Column]:
    failures = total - p1
    return [
        F.when(total > 0, (p1 + p2) / total).otherwise(F.lit(0.0)).alias("overall_pass_rate"),
        # 1.0 when nothing failed; 0.0 for a run without items.
        F.when(total == 0, F.lit(0.0)).when(failures > 0, p2 / failures)
        .otherwise(F.lit(1.0)).alias("kb_recovery_rate"),
        F.when(retried > 0, had / retried).otherwise(F.lit(0.0)).alias("lesson_utilization"),
    ]


def eval_metrics(items: DataFrame, by: str | list[str] = "run_id",
                 runs: DataFrame | None = None) -> DataFrame:
    """All ten metrics per group. ``runs`` (a frame with the ``by`` columns) restores runs
    without items, which then report zeros."""
    keys = [by] if isinstance(by, str) else list(by)
    agg = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("pass1").cast("long").alias("pass1_count"),
        F.count_if("pass2").cast("long").alias("pass2_count"),
        F.count_if("hard_failure").cast("long").alias("hard_failure_count"),
        F.count_if("retried").cast("long").alias("_retried"),
        F.count_if("had_lessons").cast("long").alias("_had"),
        F.avg("sim1").alias("avg_sim1"),
        F.avg("sim2").alias("avg_sim2"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )
    if runs is not None:
        agg = runs.select(*keys).join(agg, keys, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    zf = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    total, p1, p2 = z("total"), z("pass1_count"), z("pass2_count")
    return agg.select(
        *keys, total.alias("total"), p1.alias("pass1_count"), p2.alias("pass2_count"),
        z("hard_failure_count").alias("hard_failure_count"),
        *_rates(total, p1, p2, z("_retried"), z("_had")),
        zf("avg_sim1"), zf("avg_sim2"), zf("avg_latency_ms"))


# Report layout (fixed values: lines, labels and rules of the text report).
RULE_HEAVY = "═" * 50
RULE_LIGHT = "  " + "─" * 46


def _pct(x: Column) -> Column:
    return F.format_string("%.1f%%", F.round(x * 100, 1))


def format_report(m: DataFrame) -> Column:
    """Text report over a metrics frame: percentages with one decimal, similarities with
    three, latency without decimals; a run without items prints plain zeros."""
    total = F.col("total")
    p1, p2, hf = F.col("pass1_count"), F.col("pass2_count"), F.col("hard_failure_count")

    def count_line(label: str, c: Column) -> Column:
        return F.when(total > 0, F.format_string(label + "%d  (%s)", c, _pct(c / total))) \
            .otherwise(F.lit(label + "0"))

    lines = [
        F.lit(RULE_HEAVY), F.lit("  Evaluation Report"), F.lit(RULE_HEAVY),
        F.format_string("  Total items:          %d", total),
        count_line("  pass@1:               ", p1),
        count_line("  pass@2:               ", p2),
        count_line("  Hard failures:        ", hf),
        F.format_string("  Overall pass rate:    %s", _pct(F.col("overall_pass_rate"))),
        F.lit(RULE_LIGHT),
        F.format_string("  KB recovery rate:     %s   (%d of %d failures recovered)",
                        _pct(F.col("kb_recovery_rate")), p2, total - p1),
        F.format_string("  Lesson utilization:   %s", _pct(F.col("lesson_utilization"))),
        F.lit(RULE_LIGHT),
        F.format_string("  Avg retrieval sim:    %.3f", F.round("avg_sim1", 3)),
        F.format_string("  Avg lesson sim:       %.3f", F.round("avg_sim2", 3)),
        F.format_string("  Avg latency:          %.0f ms", F.round("avg_latency_ms", 0)),
        F.lit(RULE_HEAVY),
    ]
    return F.concat_ws("\n", *lines)


def metrics_json(m: DataFrame) -> Column:
    """JSON object of the ten metrics, in report order."""
    return F.to_json(F.struct(*[F.col(c) for c in METRIC_COLUMNS]))
