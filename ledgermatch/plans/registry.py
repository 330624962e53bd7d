"""Registered queries: a Spark callable per operator and, where SQL can say it, its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgermatch.plans.model import Model, with_model

_QUERIES: dict[str, Callable[[Model], DataFrame]] = {}
_SQL: dict[str, str] = {}
SHARED_SQL: dict[str, str] = {}  # common table expressions of the SQL side only


def query(name: str, sql: str | None = None):
    """Register ``fn(model) -> DataFrame`` under ``name``."""
    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"{name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return add


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, fn=fn: fn(Model(spark, folder))) for name, fn in _QUERIES.items()}


def sql_counterparts() -> dict[str, str]:
    return {name: with_model(sql, SHARED_SQL).replace("@@", "{:,}") for name, sql in _SQL.items()}
