"""The registered queries of the engine and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import controls, evaluations, stored, trails
from corpusloom.plans import queries as q
from corpusloom.plans.controls import CONTROL_SQL
from corpusloom.plans.evaluations import EVALUATION_SQL
from corpusloom.plans.sql import SQL as ENGINE_SQL
from corpusloom.plans.stored import STORED_SQL
from corpusloom.plans.trails import TRAIL_SQL

NAMES = (
    "bm25_topk bm25_term_stats filtered_topk leak_counts query_verdicts vector_topk hybrid_rrf hybrid_stage_scores recall_precision retrieval_summary "
    "near_empty_decisions decision_counts exact_dups canonical_copies near_dups dup_groups closest_documents quote_survival pii_counts pii_redacted running_lines whitespace_cleaned "
    "html_blocks html_without_boilerplate fixed_chunks structure_chunks interaction_rollup run_summary latency_percentiles ledger_totals budget_guard cost_model extremes "
    "newest_transactions accounts_by_member account_lookup json_limit_lookup figure_check authz_decisions reference_resolution cache_probe replay_diff per_run_failures "
    "confusion orphans round_outcomes rounds_distribution loop_limits source_lines windowed_costs"
).split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: getattr(q, name) for name in NAMES} | {name: getattr(evaluations, name) for name in EVALUATION_SQL} | {name: getattr(controls, name) for name in CONTROL_SQL} | {name: getattr(stored, name) for name in STORED_SQL} | {name: getattr(trails, name) for name in TRAIL_SQL}
SQL = ENGINE_SQL | EVALUATION_SQL | CONTROL_SQL | STORED_SQL | TRAIL_SQL
flagship = q.bm25_topk

__all__ = ["QUERIES", "SQL", "flagship"]
