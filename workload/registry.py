"""Registered queries: a Spark function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[key] = function
        if sql is not None:
            ORACLE[key] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Engines add doubles in different orders; results are compared without the last digits."""
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def with_nulls(column: str, key: str, every: int) -> Column:
    """The driver's tables hold no nulls; this puts some in, the same way as ``sql_nulls``."""
    return F.when(F.col(key) % every != 0, F.col(column))


def sql_nulls(column: str, key: str, every: int) -> str:
    return f"CASE WHEN {key} % {every} <> 0 THEN {column} END"
