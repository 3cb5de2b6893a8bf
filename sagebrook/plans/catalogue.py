"""Queries of the core and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sagebrook.plans import engine_queries, operator_queries, reference_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = engine_queries.QUERIES | operator_queries.QUERIES | reference_queries.QUERIES
ORACLE: dict[str, str] = engine_queries.ORACLE | operator_queries.ORACLE | reference_queries.ORACLE
