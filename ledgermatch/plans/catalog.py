"""Imports every query module, so that each registers itself, and exposes the full set."""

from __future__ import annotations

from ledgermatch.plans import ledger_queries, link_queries, review_queries, source_queries, stream_queries  # noqa: F401
from ledgermatch.plans.registry import spark_queries as queries
from ledgermatch.plans.registry import sql_counterparts as oracle_sql

__all__ = ["queries", "oracle_sql"]
