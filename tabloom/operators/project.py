"""Renaming, casting, dropping, filtering and adding columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import (
    DuplicateColumn,
    col,
    field_type,
    replace_columns,
    require_columns,
)
from tabloom.functions.types import cast_column


def rename_column(df: DataFrame, old_name: str, new_name: str) -> DataFrame:
    require_columns(df, [old_name])
    if new_name != old_name and new_name in df.columns:
        raise DuplicateColumn(f"column '{new_name}' already exists")
    return df.withColumnRenamed(old_name, new_name)


def change_type(df: DataFrame, column: str, new_type: str, lenient: bool = False) -> DataFrame:
    return replace_columns(df, {column: cast_column(df, column, new_type, lenient)})


def select_and_cast(df: DataFrame, types: dict[str, str | None], lenient: bool = False) -> DataFrame:
    """Keep the named columns, in this order, each cast to its type (None keeps it)."""
    require_columns(df, types)
    return df.select(
        *[(cast_column(df, c, t, lenient) if t else col(c)).alias(c) for c, t in types.items()]
    )


def delete_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    require_columns(df, columns)
    return df.drop(*columns)


def filter_rows(df: DataFrame, condition: str | Column) -> DataFrame:
    """Rows where the condition holds: SQL text, a Column, or a boolean column's name."""
    if isinstance(condition, Column):
        return df.filter(condition)
    return df.filter(col(condition) if condition in df.columns else F.expr(condition))


def equality_filters(df: DataFrame, filters: dict[str, Any]) -> DataFrame:
    """Rows equal to every given value; ``None`` means no filter on that column."""
    require_columns(df, filters)
    for name, value in filters.items():
        if value is not None:
            df = df.filter(col(name) == F.lit(value))
    return df


def add_calculated_column(df: DataFrame, new_column: str, formula: str | Column) -> DataFrame:
    value = formula if isinstance(formula, Column) else F.expr(formula)
    return df.withColumn(new_column, value)


def duplicate_column(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, [column])
    return df.withColumn(f"{column}_duplicate", col(column))


def reorder_columns(df: DataFrame, new_order: list[str]) -> DataFrame:
    """The listed columns in this order; unlisted ones leave the table."""
    require_columns(df, new_order)
    if len(set(new_order)) < len(new_order):
        raise DuplicateColumn(f"columns listed twice in {new_order}")
    return df.select(*[col(c) for c in new_order])


def replace_values(df: DataFrame, column: str, to_replace: Any, replace_with: Any) -> DataFrame:
    """Exchange one value for another, both read in the column's type; null stays null."""
    data_type = field_type(df, column)
    old, new = F.lit(to_replace).cast(data_type), F.lit(replace_with).cast(data_type)
    return replace_columns(df, {column: F.when(col(column) == old, new).otherwise(col(column))})


def head(df: DataFrame, n: int | None, order_by: list[str | Column] | None = None) -> DataFrame:
    """The first ``n`` rows (all of them for ``None``).

    Tables have no order of their own, so name one to make the choice repeatable.
    """
    if n is None:
        return df
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def has_missing(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row telling whether either column holds a null (false for an empty table)."""
    require_columns(df, [x, y])
    any_null = F.bool_or(col(x).isNull() | col(y).isNull())
    return df.agg(F.coalesce(any_null, F.lit(False)).alias("has_missing"))
