"""All queries by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import drift_queries, ledger_queries, patch_queries, record_queries, sink_queries, source_queries

FLAGSHIP = "recurrence_histogram"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (patch_queries, drift_queries, ledger_queries, record_queries, source_queries, sink_queries):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
