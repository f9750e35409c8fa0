"""Registered queries of the library and the DuckDB SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.plans import coverage, evaluation, filings, logs, projections, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = coverage.QUERIES | logs.QUERIES | texts.QUERIES | evaluation.QUERIES | filings.QUERIES | projections.QUERIES
ORACLE_SQL: dict[str, str] = coverage.ORACLE_SQL | logs.ORACLE_SQL | texts.ORACLE_SQL | evaluation.ORACLE_SQL | filings.ORACLE_SQL | projections.ORACLE_SQL
