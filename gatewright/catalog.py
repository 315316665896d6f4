"""The catalogue of queries and, beside each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import metric_queries, store_queries, text_queries

_PARTS = (metric_queries, text_queries, store_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: q for part in _PARTS for n, q in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {n: s for part in _PARTS for n, s in part.ORACLE_SQL.items()}
