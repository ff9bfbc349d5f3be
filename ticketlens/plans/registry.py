"""Registry of queries: name -> Spark builder (spark, sf_dir) -> DataFrame and
name -> DuckDB oracle SQL for the same result."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in SPARK:
            raise ValueError(f"duplicate query {name}")
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco
