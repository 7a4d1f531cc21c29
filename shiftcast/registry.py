"""Query registry: one Spark callable and (optionally) one DuckDB oracle per key.

Query modules under ``shiftcast.plans`` register themselves on import.  A key
without oracle SQL is an ML / iterative operator that the driver checks on
row counts only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query key {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql.strip()
        return fn
    return deco


def _load() -> None:
    # Import order = registration order.
    from shiftcast.plans import (  # noqa: F401
        panel_queries, calendar_queries, enrich_queries, feature_queries,
        segment_queries, forecast_queries, diagnostic_queries, serving_queries, model_queries,
        horizon_queries,
    )


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
