"""The numbers behind the exploration charts."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.columns import col, field_type, is_numeric, measure, numeric_columns, require_columns
from tabloom.functions.gram import PairSums, pair_sums
from tabloom.functions.quantiles import exact_quantiles
from tabloom.functions.stats import MAX, MIN, fit
from tabloom.operators.profile import column_summary, value_counts

BINS = 30


# -- one column ---------------------------------------------------------------

def _bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin of a value; the largest value belongs to the last bin."""
    if high == low:
        return F.when(value.isNotNull(), F.lit(0))
    width = (high - low) / bins
    place = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return F.when(value.isNotNull(), place)  # least() would skip a null


def _bin_grid(df: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """``(bin, lower, upper)`` for every bin; a constant column has a single one."""
    count = bins if high > low else 1
    width = (high - low) / bins if high > low else 0.0
    return df.sparkSession.range(count).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(low) + F.col("id") * F.lit(width)).alias("lower"),
        (F.lit(low) + (F.col("id") + 1) * F.lit(width)).alias("upper"),
    )


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """``(bin, lower, upper, count)`` with empty bins kept; nulls and NaN left out."""
    ends = fit(df, [(MIN, column), (MAX, column)])
    low, high = ends[MIN, column], ends[MAX, column]
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, count bigint")
    counts = (
        df.select(_bin(measure(df, column), low, high, bins).alias("bin"))
        .filter("bin IS NOT NULL")
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # at most one row per bin on either side
    return (
        _bin_grid(df, low, high, bins)
        .join(F.broadcast(counts), "bin", "left")
        .select("bin", "lower", "upper", F.coalesce("count", F.lit(0)).alias("count"))
    )


def density(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """``(bin, lower, upper, density)``: share of the rows per unit of the axis."""
    binned = histogram(df, column, bins)
    rows = df.agg(F.count(measure(df, column))).first()[0]
    width = F.col("upper") - F.col("lower")
    return binned.select(
        "bin",
        "lower",
        "upper",
        F.when(width > 0, F.col("count") / (F.lit(rows) * width)).alias("density"),
    )


def density_2d(df: DataFrame, x: str, y: str, bins: int = BINS) -> DataFrame:
    """``(x_bin, y_bin, count, density)`` for the occupied cells of a bins x bins grid."""
    ends = fit(df, [(s, c) for c in (x, y) for s in (MIN, MAX)])
    if ends[MIN, x] is None or ends[MIN, y] is None:
        return df.sparkSession.createDataFrame([], "x_bin int, y_bin int, count bigint, density double")
    pairs = df.select(
        _bin(measure(df, x), ends[MIN, x], ends[MAX, x], bins).alias("x_bin"),
        _bin(measure(df, y), ends[MIN, y], ends[MAX, y], bins).alias("y_bin"),
    ).filter("x_bin IS NOT NULL AND y_bin IS NOT NULL")
    rows = pairs.count()
    area = (ends[MAX, x] - ends[MIN, x]) * (ends[MAX, y] - ends[MIN, y]) / (bins * bins)
    counts = pairs.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count"))
    share = F.col("count") / F.lit(float(rows) * area) if rows and area else F.lit(None).cast("double")
    return counts.withColumn("density", share)


def box_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: quartiles, whisker ends (the furthest values within 1.5 quartile
    ranges) and the number of values beyond them."""
    quartiles = exact_quantiles(df, {column: [0.25, 0.5, 0.75]})
    q1, median, q3 = (quartiles[column, q] for q in (0.25, 0.5, 0.75))
    x = measure(df, column)
    if q1 is None:
        inside = F.lit(False)
    else:
        reach = 1.5 * (q3 - q1)
        inside = x.between(F.lit(q1 - reach), F.lit(q3 + reach))
    return df.agg(
        F.lit(q1).cast("double").alias("q1"),
        F.lit(median).cast("double").alias("median"),
        F.lit(q3).cast("double").alias("q3"),
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(x.isNotNull() & ~inside).alias("outliers"),
    )


def univariate(df: DataFrame, column: str) -> dict[str, DataFrame]:
    """Everything shown for one column: its summary and, by type, its distribution."""
    summary = column_summary(df, [column])
    if is_numeric(field_type(df, column)):
        return {
            "summary": summary,
            "histogram": histogram(df, column),
            "box": box_stats(df, column),
            "density": density(df, column),
        }
    return {"summary": summary, "value_counts": value_counts(df, column)}


# -- two and more columns -----------------------------------------------------

def _pearson(sums: PairSums, means: list[float], i: int, j: int) -> float | None:
    n = sums.n[i, j]
    if not n:
        return None
    vx, vy = (float(sums.ss[a, b] - sums.s[a, b] ** 2 / n) for a, b in ((i, j), (j, i)))
    # what rounding leaves of a constant column is not variance
    if vx <= n * (1e-14 * means[i]) ** 2 or vy <= n * (1e-14 * means[j]) ** 2:
        return None
    return float(sums.xy[i, j] - sums.s[i, j] * sums.s[j, i] / n) / math.sqrt(vx * vy)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(col_a, col_b, corr)`` for all ordered pairs, each over its complete rows.

    Two scans whatever the number of columns: means, and masked matrix products. A constant
    column correlates with nothing (null), not even itself.
    """
    require_columns(df, columns)
    names = [c for c in columns if is_numeric(field_type(df, c))]
    cells = {}
    if names:
        sums, means = pair_sums(df, names)
        for (i, j) in combinations_with_replacement(range(len(names)), 2):
            value = _pearson(sums, means, i, j)
            cells[names[i], names[j]] = cells[names[j], names[i]] = value
    return df.sparkSession.createDataFrame(
        [(a, b, corr) for (a, b), corr in cells.items()], "col_a string, col_b string, corr double"
    )


def correlation_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation over the rows where both values are present."""
    sums, means = pair_sums(df, [x, y])
    return df.sparkSession.createDataFrame([(_pearson(sums, means, 0, 1),)], "corr double")


def correlation_numeric(df: DataFrame) -> DataFrame:
    """The correlation matrix of every numeric column; empty when there is none."""
    return correlation_matrix(df, numeric_columns(df))


def bar_totals(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(<x>, total)``: bar heights, the sum of ``y`` per value of ``x``."""
    require_columns(df, [x])
    return df.groupBy(col(x)).agg(F.sum(measure(df, y)).alias("total"))


def scatter_points(df: DataFrame, columns: list[str]) -> DataFrame:
    """The points of a scatter plot, a pair plot or, for three columns, a 3-D plot."""
    require_columns(df, columns)
    not_numeric = [c for c in columns if not is_numeric(field_type(df, c))]
    if not_numeric:
        raise TypeError(f"columns {not_numeric} are not numeric")
    return df.select(*[col(c) for c in columns])


def bivariate(df: DataFrame, x: str, y: str) -> dict[str, DataFrame]:
    """Two numbers: points and their correlation. A text and a number: bar totals."""
    x_type, y_type = field_type(df, x), field_type(df, y)
    if is_numeric(x_type) and is_numeric(y_type):
        return {"points": scatter_points(df, [x, y]), "correlation": correlation_pair(df, x, y)}
    if isinstance(x_type, T.StringType) and is_numeric(y_type):
        return {"bars": bar_totals(df, x, y)}
    if isinstance(y_type, T.StringType) and is_numeric(x_type):
        return {"bars": bar_totals(df, y, x)}
    raise TypeError(f"no chart for {x_type.simpleString()} against {y_type.simpleString()}")


def cross_tab(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(<a>, <b>, count)`` for the pairs that occur; null is a value."""
    require_columns(df, [a, b])
    return df.groupBy(col(a), col(b)).agg(F.count(F.lit(1)).alias("count"))


def cross_tab_wide(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """One row per value of ``a``, one zero-filled column per listed value of ``b``."""
    require_columns(df, [a, b])
    return df.groupBy(col(a)).agg(*[F.count_if(col(b) == F.lit(v)).alias(str(v)) for v in values])
