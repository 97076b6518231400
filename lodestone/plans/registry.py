"""Registration of queries next to their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None):
    """Registers a function of a table reader ``t`` under its name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda table: read(spark, sf_dir, table))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register
