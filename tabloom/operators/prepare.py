"""Filling, scaling and outlier steps.

Each step splits into what it must know about the data (``*_needs``, a list of
statistics for :func:`tabloom.functions.stats.fit`) and a projection or filter
with those values as literals (``apply_*``). The second half never looks at the
data, so it can run on new rows or on a stream. The plain functions do both.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from tabloom.functions.columns import col, measure, replace_columns, require_columns
from tabloom.functions.stats import MAX, MEAN, MEDIAN, MIN, MODE, STD_POP, STD_SAMP, Need, bound, fit, mean_like

FILLERS = {"Mean": MEAN, "Median": MEDIAN, "Mode": MODE}


# -- missing values -----------------------------------------------------------

def fill_value(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Replace nulls by a value read in the column's type; a value that cannot be is an error."""
    require_columns(df, [column])
    return replace_columns(df, {column: F.coalesce(col(column), bound(df, column, value))})


def fill_needs(columns: list[str], method: str) -> list[Need]:
    if method not in FILLERS:
        raise ValueError(f"unknown fill method '{method}'; choose one of {sorted(FILLERS)}")
    return [(FILLERS[method], c) for c in columns]


def apply_fill(df: DataFrame, columns: list[str], method: str, fitted: dict[Need, Any]) -> DataFrame:
    changes = {}
    for c in columns:
        value = fitted[FILLERS[method], c]
        if method == "Mode":
            changes[c] = F.coalesce(col(c), bound(df, c, value))
        else:
            changes[c] = F.coalesce(mean_like(df, c), F.lit(value).cast("double"))
    return replace_columns(df, changes)


def impute(df: DataFrame, columns: list[str], method: str) -> DataFrame:
    """Fill nulls with the column's mean, median or mode; all columns fit together."""
    return apply_fill(df, columns, method, fit(df, fill_needs(columns, method)))


# -- scaling ------------------------------------------------------------------

def scale_needs(columns: list[str], method: str) -> list[Need]:
    extra = (MEAN, STD_POP) if method == "StandardScaler" else ()
    return [(stat, c) for c in columns for stat in (MIN, MAX, *extra)]


def apply_scale(df: DataFrame, columns: list[str], method: str, fitted: dict[Need, Any]) -> DataFrame:
    changes = {}
    for c in columns:
        value = col(c).cast("double")
        low, high = fitted[MIN, c], fitted[MAX, c]
        if low == high:  # constant (or without values): nothing to divide by
            changes[c] = F.when(value.isNotNull(), F.lit(0.0))
        elif method == "StandardScaler":
            changes[c] = (value - F.lit(fitted[MEAN, c])) / F.lit(fitted[STD_POP, c])
        else:
            changes[c] = (value - F.lit(low)) / F.lit(high - low)
    return replace_columns(df, changes)


def scale(df: DataFrame, columns: list[str], method: str = "StandardScaler") -> DataFrame:
    """``StandardScaler``: (x - mean) / population deviation; any other name: min-max to [0, 1]."""
    return apply_scale(df, columns, method, fit(df, scale_needs(columns, method)))


# -- outliers -----------------------------------------------------------------

IQR, Z_SCORE = "IQR Method", "Z-Score Method"


def outlier_needs(column: str, method: str, interpolation: str = "linear", ddof: int = 0) -> list[Need]:
    if method == IQR:
        kind = "quantile" if interpolation == "linear" else interpolation
        return [(kind, column, 0.25), (kind, column, 0.75)]
    if method == Z_SCORE:
        return [(MEAN, column), (STD_SAMP if ddof else STD_POP, column), (MIN, column), (MAX, column)]
    raise ValueError(f"unknown outlier method '{method}'")


def apply_outliers(
    df: DataFrame,
    column: str,
    method: str,
    fitted: dict[Need, Any],
    interpolation: str = "linear",
    ddof: int = 0,
    one_sided: bool = False,
) -> DataFrame:
    first, second, *ends = (fitted[n] for n in outlier_needs(column, method, interpolation, ddof))
    # without values, or without any spread to divide by, no row passes the test
    if first is None or second is None or (ends and ends[0] == ends[1]):
        return df.filter(F.lit(False))
    if method == IQR:
        reach = 1.5 * (second - first)
        return df.filter(col(column).between(F.lit(first - reach), F.lit(second + reach)))
    distance = measure(df, column) - F.lit(first)
    return df.filter((distance if one_sided else F.abs(distance)) < F.lit(3.0 * second))


def remove_outliers(
    df: DataFrame,
    column: str,
    method: str,
    interpolation: str = "linear",
    ddof: int = 0,
    one_sided: bool = False,
) -> DataFrame:
    """Keep rows within 1.5 quartile ranges (inclusive) or below 3 deviations; nulls go.

    ``one_sided=True, ddof=1`` keeps everything far below the mean and uses the
    sample deviation.
    """
    fitted = fit(df, outlier_needs(column, method, interpolation, ddof))
    return apply_outliers(df, column, method, fitted, interpolation, ddof, one_sided)
