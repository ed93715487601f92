"""The library's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analyze_queries, assemble_queries, change_queries, chunk_queries, graph_queries, lexical_queries, store_queries, text_queries, vector_queries

_MODULES = [lexical_queries, text_queries, chunk_queries, vector_queries, graph_queries, assemble_queries, analyze_queries, change_queries, store_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _MODULES for name, s in m.SQL.items()}
