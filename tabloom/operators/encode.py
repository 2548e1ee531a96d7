"""Turning categories into numbers."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.functions.columns import DuplicateColumn, col, field_type, require_columns
from tabloom.operators.merge import merge
from tabloom.session import scratch_folder


class TooManyCategories(ValueError):
    """A one-hot encoding would add more columns than allowed."""


def sorted_categories(df: DataFrame, column: str, at_most: int | None = None) -> list[Any] | None:
    """The distinct values in order, or None when there are more than a given ``at_most``."""
    require_columns(df, [column])
    values = df.select(col(column).alias("value")).filter("value IS NOT NULL").distinct().orderBy("value")
    rows = (values if at_most is None else values.limit(at_most + 1)).collect()
    return None if at_most is not None and len(rows) > at_most else [r["value"] for r in rows]


# -- one-hot ------------------------------------------------------------------

def one_hot_categories(df: DataFrame, columns: list[str], max_categories: int | None = None) -> dict[str, list]:
    """The categories of each column, from one pass; each becomes a column of the plan, which a caller may limit."""
    require_columns(df, columns)
    types = [field_type(df, c) for c in columns]
    # a cell has its value in the field of its column, so all types keep their order
    cells = [
        F.struct(F.lit(i).alias("i"), *[(col(c) if j == i else F.lit(None).cast(t)).alias(f"v{j}") for j, t in enumerate(types)])
        for i, c in enumerate(columns)
    ]
    fields = [f"v{j}" for j in range(len(columns))]
    distinct = df.select(F.inline(F.array(*cells))).filter(reduce(Column.__or__, [F.col(f).isNotNull() for f in fields])).distinct()
    if max_categories is not None:  # no more than show that there are too many
        first = F.row_number().over(Window.partitionBy("i").orderBy(*fields))
        distinct = distinct.withColumn("n", first).filter(F.col("n") <= max_categories + 1)
    found: dict[str, list] = {c: [] for c in columns}
    for row in distinct.orderBy("i", *fields).collect():
        found[columns[row["i"]]].append(row[f"v{row['i']}"])
    for c, values in found.items():
        if max_categories is not None and len(values) > max_categories:
            raise TooManyCategories(
                f"column '{c}' has more than {max_categories} categories; raise max_categories or label-encode it"
            )
    return found


def apply_one_hot(df: DataFrame, categories: dict[str, list]) -> DataFrame:
    """Drop the sources and append ``<column>_<value>`` for all but the first category."""
    kept = [c for c in df.columns if c not in categories]
    added = {
        f"{c}_{v}": F.when(col(c) == F.lit(v), 1.0).otherwise(0.0)
        for c, values in categories.items()
        for v in values[1:]
    }
    clash = sorted(set(kept) & set(added))
    if clash:
        raise DuplicateColumn(f"one-hot columns {clash} already exist")
    return df.select(*[col(c) for c in kept], *[e.alias(n) for n, e in added.items()])


def one_hot(df: DataFrame, columns: list[str], max_categories: int | None = None) -> DataFrame:
    return apply_one_hot(df, one_hot_categories(df, columns, max_categories))


# -- label codes --------------------------------------------------------------

def label_codes(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: the distinct values numbered from 0 in sorted order.

    The values are dealt by ranges and written once with the number of their
    range; they are then numbered inside each range and shifted by the sizes of
    the ranges before, so no task holds more than its range. A recomputed task
    numbers alike, as the ranges are read from the table. The driver sees one
    count per range.
    """
    distinct = df.select(col(column).alias("value")).filter("value IS NOT NULL").distinct()
    path = scratch_folder(df.sparkSession, "labels")
    dealt = distinct.repartitionByRange("value").withColumn("range", F.spark_partition_id())
    dealt.write.mode("overwrite").parquet(path)
    ranged = df.sparkSession.read.schema(dealt.schema).parquet(path)
    sizes = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}
    before = [0]
    for number in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(number, 0))
    place = F.row_number().over(Window.partitionBy("range").orderBy("value")) - 1
    offset = F.get(F.array(*[F.lit(n).cast("bigint") for n in before]), F.col("range"))
    return ranged.select("value", (offset + place).cast("bigint").alias("code"))


def apply_label_codes(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Swap the column for its code; null and unseen values become null."""
    keyed = codes.select(F.col("value").alias(column), F.col("code").alias("__code"))
    joined = merge(df, keyed, column, "left")
    return joined.select(*[F.col("__code").alias(c) if c == column else col(c) for c in df.columns])


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each column by the position of its value among the sorted distinct values."""
    for c in columns:
        df = apply_label_codes(df, c, label_codes(df, c))
    return df
