"""Query registry: name -> (spark builder, DuckDB twin SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sqlfix import with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_fixtures(sql)
        return fn
    return deco


def load_all():
    # importing the modules fills the registry
    from . import q_catalog, q_audit, q_dml, q_metrics, q_windows, q_resilience, q_scalar, q_sources, q_streams  # noqa: F401
    return QUERIES, SQL
