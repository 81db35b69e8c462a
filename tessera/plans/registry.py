"""Name -> query function, for ``__spark_entry__.queries()``, the benchmark and the tests."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import ensure_checkpoint_dir

from tessera.plans import ingest, records, repairs, retrieval, runs, text, training, workflow, workload

QueryFn = Callable[[SparkSession, str], DataFrame]


def _with_checkpoint_dir(fn: QueryFn) -> QueryFn:
    """Queries write stage outputs to the shared checkpoint folder: make sure the session
    names one (the cluster's setting is kept; a folder of our own only when unset)."""
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)
    return run


def all_queries() -> dict[str, QueryFn]:
    q: dict[str, QueryFn] = {
        "topk_examples": retrieval.q_topk_examples,
        "topk_lessons": retrieval.q_topk_lessons,
        "topk_lessons_asof": retrieval.q_topk_lessons_asof,
        "topk_examples_cells": retrieval.q_topk_examples_cells,
        "topk_lessons_ranges": retrieval.q_topk_lessons_ranges,
        "topk_turns": retrieval.q_topk_turns,
        "retrieval_confidence": retrieval.q_retrieval_confidence,
        "l2_normalize": retrieval.q_l2_normalize,
        "kb_counts": retrieval.q_kb_counts,
        "hits_to_records": retrieval.q_hits_to_records,
        "validate_sql_texts": text.q_validate_sql_texts,
        "strip_fences": text.q_strip_fences,
        "token_similarity": text.q_token_similarity,
        "sql_canonical": text.q_sql_canonical,
        "sql_compare": text.q_sql_compare,
        "sql_variants": text.q_sql_variants,
        "extract_json": text.q_extract_json,
        "parse_lessons": text.q_parse_lessons,
    }
    q.update({
        "eval_metrics": records.q_eval_metrics,
        "eval_metrics_by_run": records.q_eval_metrics_by_run,
        "metrics_report": records.q_metrics_report,
        "metrics_json": records.q_metrics_json,
        "train_eval_split": records.q_train_eval_split,
        "split_leakage_check": records.q_split_leakage_check,
        "backfill_union": records.q_backfill_union,
        "kb_upsert": records.q_kb_upsert,
        "kb_append": records.q_kb_append,
        "run_status_latest": records.q_run_status_latest,
        "fk_orphans": records.q_fk_orphans,
        "retry_gate": records.q_retry_gate,
        "hash_embed": records.q_hash_embed,
    })
    q.update({
        "sql_prompts": workflow.q_sql_prompts,
        "prompt_blocks": workflow.q_prompt_blocks,
        "nlq_prompts": workflow.q_nlq_prompts,
        "critic_prompts": workflow.q_critic_prompts,
        "lesson_prompts": workflow.q_lesson_prompts,
        "model_responses": workflow.q_model_responses,
        "eval_attempts": workflow.q_eval_attempts,
        "eval_run_metrics": workflow.q_eval_run_metrics,
        "answer_questions": workflow.q_answer_questions,
        "repair_outcome": repairs.q_repair_outcome,
        "repair_history": repairs.q_repair_history,
        "repair_observations": repairs.q_repair_observations,
        "repair_rounds": repairs.q_repair_rounds,
        "ingest_pairs": ingest.q_ingest_pairs,
        "fill_missing_nlq": ingest.q_fill_missing_nlq,
        "stream_ingest_pairs": ingest.q_stream_ingest_pairs,
        "stream_lessons": ingest.q_stream_lessons,
        "kb_append_stored": ingest.q_kb_append_stored,
        "training_cycle_metrics": training.q_training_cycle_metrics,
        "training_run_stored": runs.q_training_run_stored,
    })
    q.update(workload.QUERIES)
    return {k: _with_checkpoint_dir(f) for k, f in q.items()}
