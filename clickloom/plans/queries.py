"""Every query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clickloom.plans import analysis, features, models

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**analysis.QUERIES, **features.QUERIES, **models.QUERIES}
ORACLE_SQL: dict[str, str] = {**analysis.ORACLE_SQL, **features.ORACLE_SQL, **models.ORACLE_SQL}
