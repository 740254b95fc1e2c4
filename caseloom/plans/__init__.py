"""Registered queries over the driver's tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bulletins, casework, curation, dashboards, lookups, pages, retrieval, texts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dashboards.QUERIES | texts.QUERIES | casework.QUERIES | lookups.QUERIES | bulletins.QUERIES | curation.QUERIES | pages.QUERIES | retrieval.QUERIES


def oracle_sql() -> dict[str, str]:
    return dashboards.SQL | texts.SQL | casework.SQL | lookups.SQL | bulletins.SQL | curation.SQL | pages.SQL | retrieval.SQL
