"""All analytics queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kpiscope.plans import causal_queries, conform_queries, decision_queries, graph_queries, inference_queries, kpi_queries, quality_queries, stream_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (kpi_queries, quality_queries, conform_queries, causal_queries, inference_queries, graph_queries, decision_queries, stream_queries)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
