"""What a model expects of a table, kept beside it, and scoring a new table that has the actual target.

A contract holds the names and types of the features, the values of text features with their counts, and
the edges and counts of ten bins of number features. Values are a table, as they can be many; the rest is
one line of JSON.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabloom.functions.columns import col, field_type, is_numeric, measure, require_columns

BINS = 10
CHECKS = "column_name string, rows bigint, missing bigint, unseen bigint, shift double"


@dataclass
class Contract:
    """``types`` by feature, ``edges`` (low, high) and ``counts`` of the bins of number features, the
    number of rows learnt from, and the table ``(column_name, value, n)`` of text features."""

    types: dict[str, str]
    edges: dict[str, tuple[float, float]] = field(default_factory=dict)
    counts: dict[str, list[int]] = field(default_factory=dict)
    rows: int = 0
    values: DataFrame | None = None


def _bin(value: Column, low: float, high: float) -> Column:
    """0 below the first bin, 1 to ``BINS`` in it, ``BINS`` + 1 above; null stays null."""
    if high <= low:
        return F.when(value < low, 0).when(value > high, BINS + 1).when(value.isNotNull(), 1)
    place = F.least(F.floor((value - low) / ((high - low) / BINS)), F.lit(BINS - 1)) + 1
    return F.when(value < low, 0).when(value > high, BINS + 1).when(value.isNotNull(), place.cast("int"))


def _bin_counts(df: DataFrame, edges: dict[str, tuple[float, float]]) -> dict[str, list[int]]:
    """Rows by bin for every number feature, from one scan."""
    if not edges:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("c"), _bin(measure(df, c), *e).alias("bin")) for c, e in edges.items()])
    out = {c: [0] * (BINS + 2) for c in edges}
    for r in df.select(F.inline(cells)).filter("bin IS NOT NULL").groupBy("c", "bin").count().collect():
        out[r["c"]][r["bin"]] = r["count"]
    return out


def _texts(df: DataFrame, names: list[str]) -> DataFrame | None:
    """``(column_name, value, n)`` of the present values of text features, in one shuffle."""
    if not names:
        return None
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("value")) for c in names])
    return df.select(F.inline(cells)).filter("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def learn(df: DataFrame, features: list[str]) -> Contract:
    """The contract of a training table."""
    require_columns(df, features)
    numbers = [c for c in features if is_numeric(field_type(df, c))]
    ends = df.agg(F.count(F.lit(1)), *[f(measure(df, c)) for c in numbers for f in (F.min, F.max)]).first()
    edges = {c: (ends[1 + 2 * i], ends[2 + 2 * i]) for i, c in enumerate(numbers) if ends[1 + 2 * i] is not None}
    return Contract(
        {c: field_type(df, c).simpleString() for c in features}, edges, _bin_counts(df, edges), ends[0], _texts(df, [c for c in features if c not in numbers])
    )


def save(spark: SparkSession, contract: Contract, path: str) -> str:
    plain = asdict(Contract(contract.types, contract.edges, contract.counts, contract.rows))
    spark.createDataFrame([(json.dumps(plain),)], "contract string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")
    values = contract.values if contract.values is not None else spark.createDataFrame([], "column_name string, value string, n bigint")
    values.write.mode("overwrite").parquet(f"{path}/values")
    return path


def load(spark: SparkSession, path: str) -> Contract:
    plain = json.loads(spark.read.text(f"{path}/contract").first()[0])
    plain["edges"] = {c: tuple(e) for c, e in plain["edges"].items()}
    return Contract(**{**plain, "values": spark.read.parquet(f"{path}/values")})


def require(contract: Contract, df: DataFrame) -> None:
    """Names must be there; numbers may be of any number type, other types must be as learnt."""
    require_columns(df, contract.types)
    wrong = []
    for name, learnt in contract.types.items():
        found = field_type(df, name)
        if found.simpleString() != learnt and not (is_numeric(found) and is_numeric(T._parse_datatype_string(learnt))):
            wrong.append(f"'{name}' is {found.simpleString()}, learnt as {learnt}")
    if wrong:
        raise TypeError("; ".join(wrong))


def _stability(learnt: list[int], found: list[int]) -> float | None:
    """Population stability index over the bins, with half a row in empty ones."""
    a, b = sum(learnt), sum(found)
    if not a or not b:
        return None
    shares = [(max(x, 0.5) / a, max(y, 0.5) / b) for x, y in zip(learnt, found)]
    return sum((q - p) * math.log(q / p) for p, q in shares)


def checks(contract: Contract, df: DataFrame) -> DataFrame:
    """``(column_name, rows, missing, unseen, shift)`` of each feature: rows with a value the training
    table did not have (numbers: outside its range), and how far the bins of a number have moved."""
    require(contract, df)
    spark, names = df.sparkSession, list(contract.types)
    present = df.agg(F.count(F.lit(1)), *[F.count(measure(df, c) if is_numeric(field_type(df, c)) else col(c)) for c in names]).first()
    found = _bin_counts(df, contract.edges)
    texts = [c for c in names if not is_numeric(field_type(df, c))]
    fresh: dict[str, int] = {}
    if texts:
        known = contract.values.select("column_name", "value")
        new = _texts(df, texts).join(known, ["column_name", "value"], "left_anti")
        fresh = {r["column_name"]: r["n"] for r in new.groupBy("column_name").agg(F.sum("n").alias("n")).collect()}
    rows = []
    for i, c in enumerate(names):
        if c in texts:
            unseen, shift = fresh.get(c, 0), None
        elif c in found:
            unseen, shift = found[c][0] + found[c][-1], _stability(contract.counts[c], found[c])
        else:  # the training table had no value at all
            unseen, shift = present[1 + i], None
        rows.append((c, present[0], present[0] - present[1 + i], unseen, shift))
    return spark.createDataFrame(rows, CHECKS)


def score_table(
    contract: Contract, predict: Callable[[DataFrame], DataFrame], df: DataFrame, target: str, metrics: list[Callable[[DataFrame, str, str], DataFrame]]
) -> dict[str, DataFrame | list[DataFrame]]:
    """``predictions`` (the rows with ``predict`` beside them), ``checks`` of the features, and ``metrics``
    of the rows that have an actual target. A table that breaks the contract raises."""
    require_columns(df, [target])
    found = checks(contract, df)
    scored = predict(df)
    return {"predictions": scored, "checks": found, "metrics": [m(scored, target, "predict") for m in metrics]}


def union_metrics(tables: list[DataFrame]) -> DataFrame:
    """One-row metric tables as ``(metric, value)``."""
    return reduce(DataFrame.unionByName, [t.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in t.columns]))) for t in tables])
