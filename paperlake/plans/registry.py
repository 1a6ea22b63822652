"""All registered queries of the extraction engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperlake.plans import files, grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = grid.QUERIES | files.QUERIES
ORACLE_SQL: dict[str, str] = grid.ORACLE_SQL | files.ORACLE_SQL
