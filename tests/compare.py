"""Compares a registered query with its SQL, value by value."""

from __future__ import annotations

import datetime
import decimal
import math
from typing import Any

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def plain(value: Any) -> Any:
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    return str(value)


def rows(names: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def differences(spark_df: Any, db: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    found = spark_df.collect()
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} against {sorted(names)}"]
    if len(found) != len(expected):
        return [f"{len(found)} rows against {len(expected)}"]
    ours, theirs = rows(spark_df.columns, [tuple(r) for r in found]), rows(names, expected)
    return [f"{a} against {b}" for a, b in zip(ours, theirs) if a != b][:5]
