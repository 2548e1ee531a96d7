"""Column look-up and the checks Spark itself leaves out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


class MissingColumn(KeyError):
    """A step names a column the table does not have."""

    def __str__(self) -> str:
        return self.args[0]


class DuplicateColumn(ValueError):
    """A step would give two columns the same name."""


def col(name: str) -> Column:
    """``F.col`` for any header text, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumn(f"columns {missing} not found; the table has {df.columns}")


def field_type(df: DataFrame, name: str) -> T.DataType:
    require_columns(df, [name])
    return df.schema[name].dataType


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def measure(df: DataFrame, name: str) -> Column:
    """A numeric column as double with NaN read as missing, for fitted statistics."""
    data_type = field_type(df, name)
    if not is_numeric(data_type):
        raise TypeError(f"column '{name}' is {data_type.simpleString()}, not numeric")
    if is_floating(data_type):
        value = col(name).cast("double")
        return F.when(~F.isnan(value), value)
    return col(name).cast("double")


def replace_columns(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Swap the given columns in place, keeping the column order (one projection)."""
    return df.select(*[changes[c].alias(c) if c in changes else col(c) for c in df.columns])
