"""All queries of the core, by name, and the SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.plans import benchmarks, evidence, intervals, search, storage, streams, text

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (intervals, text, search, evidence, storage, benchmarks, streams)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return search.hybrid_rrf(spark, folder)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
