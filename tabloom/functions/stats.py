"""Value counts for many columns in one shuffle, and the fits that steps bind."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.columns import col, field_type, is_floating, is_numeric, measure, require_columns
from tabloom.functions.quantiles import exact_quantiles

MEAN, STD_POP, STD_SAMP, MIN, MAX = "mean", "std_pop", "std_samp", "min", "max"
MEDIAN, MODE = "median", "mode"
Need = tuple[str, str] | tuple[str, str, float]  # (statistic, column[, fraction])


def countable(df: DataFrame, name: str) -> Column:
    """A value of the column that can be grouped: nested types become JSON text."""
    data_type = field_type(df, name)
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(col(name).isNotNull(), F.to_json(F.struct(col(name))))
    return col(name)


def value_counts_by_column(df: DataFrame, columns: Iterable[str]) -> list[tuple[list[str], DataFrame]]:
    """Per kind of type, the columns of that kind and their ``(name, value, n)``,
    each from one scan and one shuffle.

    Counting is combined on the map side, so a value that fills a third of the
    table costs one row per task in the shuffle.
    """
    kinds: dict[str, list[str]] = {}
    for name in columns:
        data_type = field_type(df, name)
        if isinstance(data_type, T.IntegralType):
            kind = "bigint"
        elif is_floating(data_type):
            kind = "double"
        elif isinstance(data_type, (T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            kind = data_type.simpleString()
        else:
            kind = "string"
        kinds.setdefault(kind, []).append(name)
    return [(names, _counts(df, names, kind)) for kind, names in kinds.items()]


def _counts(df: DataFrame, names: list[str], kind: str) -> DataFrame:
    if len(names) == 1:  # no need to expand rows for a single column
        typed = df.select(F.lit(names[0]).alias("name"), countable(df, names[0]).cast(kind).alias("value"))
    else:
        typed = df.select(*[countable(df, n).cast(kind).alias(n) for n in names]).unpivot(
            [], [col(n) for n in names], "name", "value"
        )
    return typed.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(name: str) -> Column:
    """Mode of one column over ``(name, value, n)`` rows: nulls ignored, the smallest
    value wins a tie.

    For an aggregate without keys: grouped by name, Spark would have to sort the
    rows, because the running minimum has no fixed width.
    """
    value, n = F.col("value"), F.col("n")
    return F.min_by(value, F.when((F.col("name") == name) & value.isNotNull(), F.struct(-n, value)))


def modes(df: DataFrame, columns: Iterable[str]) -> dict[str, Any]:
    result: dict[str, Any] = {}
    for names, counts in value_counts_by_column(df, columns):
        row = counts.agg(*[most_frequent(c).alias(f"v{i}") for i, c in enumerate(names)]).first()
        result.update(zip(names, row))
    return result


def fit(df: DataFrame, needs: Iterable[Need]) -> dict[Need, Any]:
    """Compute all needed statistics of ``df`` in as few passes as their kinds allow.

    A fraction ``f`` is asked for as ``("quantile", column, f)`` or, for the
    closest element, ``("nearest", column, f)``.
    """
    needs = list(dict.fromkeys(needs))
    require_columns(df, [n[1] for n in needs])
    simple = {
        MEAN: F.avg,
        STD_POP: F.stddev_pop,
        STD_SAMP: F.stddev_samp,
        MIN: F.min,
        MAX: F.max,
    }
    fitted: dict[Need, Any] = {}
    plain = [n for n in needs if n[0] in simple]
    if plain:
        row = df.agg(*[simple[n[0]](measure(df, n[1])).alias(f"s{i}") for i, n in enumerate(plain)]).first()
        fitted.update({n: row[i] for i, n in enumerate(plain)})

    for kind, interpolation in (("quantile", "linear"), ("nearest", "nearest")):
        wanted: dict[str, list[float]] = {}
        for n in needs:
            if n[0] == kind:
                wanted.setdefault(n[1], []).append(n[2])
            elif n[0] == MEDIAN and kind == "quantile":
                wanted.setdefault(n[1], []).append(0.5)
        quantiles = exact_quantiles(df, wanted, interpolation)
        fitted.update({n: quantiles[n[1], n[2]] for n in needs if n[0] == kind})
        if kind == "quantile":
            fitted.update({n: quantiles[n[1], 0.5] for n in needs if n[0] == MEDIAN})

    moded = [n[1] for n in needs if n[0] == MODE]
    if moded:
        found = modes(df, moded)
        fitted.update({(MODE, c): found.get(c) for c in moded})
    return fitted


def bound(df: DataFrame, name: str, value: Any) -> Column:
    """A fitted value as a literal of the column's own type."""
    return F.lit(value).cast(field_type(df, name))


def mean_like(df: DataFrame, name: str) -> Column:
    """The column as it must be to hold a mean or median: whole numbers become double."""
    data_type = field_type(df, name)
    if is_numeric(data_type) and not is_floating(data_type):
        return col(name).cast("double")
    return col(name)
