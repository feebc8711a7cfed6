"""Named queries over the driver's tables and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import admin_queries, history_queries, index_queries, record_queries, text_queries, value_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return record_queries.QUERIES | text_queries.QUERIES | value_queries.QUERIES | admin_queries.QUERIES | index_queries.QUERIES | history_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return record_queries.SQL | text_queries.SQL | value_queries.SQL | admin_queries.SQL | index_queries.SQL | history_queries.SQL
