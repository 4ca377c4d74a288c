"""Named queries of the trace operators and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("interval_queries", "usage_queries", "text_queries", "label_queries", "rollout_queries", "reprocess_queries", "scan_queries", "bundle_queries", "review_queries", "merge_queries", "document_queries", "session_queries", "curation_queries", "trace_queries", "capture_queries", "training_queries")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"loomtrace.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"loomtrace.plans.{m}").SQL.items()}
