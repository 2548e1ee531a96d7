"""Summaries of tables and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.bounded import few_values
from tabloom.functions.columns import col, field_type, is_numeric, require_columns
from tabloom.functions.quantiles import exact_quantiles
from tabloom.functions.stats import countable, most_frequent, value_counts_by_column
from tabloom.operators.project import head

QUARTILES = [0.25, 0.5, 0.75]

# Fixed widths in bytes of the types that have one
WIDTHS = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.LongType: 8,
    T.FloatType: 4,
    T.DoubleType: 8,
    T.DateType: 4,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
    T.DayTimeIntervalType: 8,
    T.DecimalType: 16,
}


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``duplicate_rows`` is half the rows that occur more than once, rounded down;
    ``extra_rows`` are those a ``distinct`` would remove."""
    keys = [countable(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)]
    n = F.col("n")
    return (
        df.select(*keys)
        .groupBy(*[f"k{i}" for i in range(len(keys))])
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(n > 1)
        .agg(
            F.floor(F.coalesce(F.sum(n), F.lit(0)) / 2).cast("bigint").alias("duplicate_rows"),
            F.coalesce(F.sum(n - 1), F.lit(0)).cast("bigint").alias("extra_rows"),
        )
    )


def _bytes(df: DataFrame, name: str) -> Column:
    """Logical bytes of one cell: type width, UTF-8 length of texts, elements of arrays."""
    value, data_type = col(name), field_type(df, name)
    if type(data_type) in WIDTHS:
        size: Column = F.lit(WIDTHS[type(data_type)])
    elif isinstance(data_type, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(data_type, T.ArrayType) and type(data_type.elementType) in WIDTHS:
        size = F.size(value) * WIDTHS[type(data_type.elementType)]
    else:
        size = F.octet_length(countable(df, name).cast("string"))
    return F.when(value.isNotNull(), size).otherwise(0).cast("bigint")


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0).cast("bigint"))


def logical_size(df: DataFrame) -> DataFrame:
    """``size_bytes`` and ``size_mb`` (two digits) of the cells, whatever the file format."""
    total = F.coalesce(F.sum(_sum([_bytes(df, c) for c in df.columns])), F.lit(0)).cast("bigint")
    return df.agg(total.alias("size_bytes")).withColumn("size_mb", F.round(F.col("size_bytes") / (1024 * 1024), 2))


def dataset_summary(df: DataFrame) -> DataFrame:
    """``(metric, value)``: rows, columns, missing cells, duplicate rows, size in MB."""
    missing = F.coalesce(F.sum(_sum([col(c).isNull().cast("bigint") for c in df.columns])), F.lit(0))
    size = F.coalesce(F.sum(_sum([_bytes(df, c) for c in df.columns])), F.lit(0))
    scanned = df.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.lit(float(len(df.columns))).alias("columns"),
        missing.cast("double").alias("missing_values"),
        F.round(size / (1024 * 1024), 2).cast("double").alias("size_mb"),
    )
    long = scanned.unpivot([], scanned.columns, "metric", "value")
    repeated = duplicate_rows(df).select(
        F.lit("duplicate_rows").alias("metric"), F.col("duplicate_rows").cast("double").alias("value")
    )
    return long.unionByName(repeated)


def _numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per numeric column: plain statistics from a single scan.

    The columns become rows before the partial aggregate, so the compiled code
    stays the same size however wide the table is.
    """
    x = F.col("x")
    present = F.when(~F.isnan(x), x)
    grouped = (
        df.select(*[col(c).cast("double").alias(c) for c in columns])
        .unpivot([], [col(c) for c in columns], "column_name", "x")
        .groupBy("column_name")
        .agg(
            F.count(x).alias("count"),
            F.count_if(x.isNull()).alias("null_count"),
            F.avg(present).alias("mean"),
            F.stddev_samp(present).alias("std"),
            F.min(present).alias("min"),
            F.max(present).alias("max"),
        )
    )
    return _together(df, columns, [grouped]).fillna(0, ["count", "null_count"])


def _together(df: DataFrame, columns: list[str], parts: list[DataFrame]) -> DataFrame:
    """One row per column from parts that each know some of its numbers.

    Every column has a row, also those of an empty table, which has no groups.
    """
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name"))
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, names)
    numbers = [c for c in united.columns if c != "column_name"]
    return united.groupBy("column_name").agg(*[F.max(c).alias(c) for c in numbers])


def _by_column(found: dict[str, float | None]) -> Column:
    """A value bound per column, looked up by ``column_name``."""
    cells = [F.lit(x) for c, value in found.items() if value is not None for x in (c, value)]
    return F.try_element_at(F.create_map(*cells), F.col("column_name")) if cells else F.lit(None).cast("double")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, statistic, value, text)`` for count, null_count, mean, std (sample),
    min, the quartiles and max. Columns that are not numeric have counts only as
    numbers; their smallest and largest values are in ``text``."""
    columns = columns or df.columns
    require_columns(df, columns)
    numeric = [c for c in columns if is_numeric(field_type(df, c))]
    others = [c for c in columns if c not in numeric]
    parts = []
    if numeric:
        quartiles = exact_quantiles(df, {c: QUARTILES for c in numeric})
        wide = _numbers(df, numeric).withColumns(
            {f"{q:.0%}": _by_column({c: quartiles[c, q] for c in numeric}) for q in QUARTILES}
        )
        statistics = [c for c in wide.columns if c != "column_name"]
        parts.append(
            wide.select("column_name", *[col(c).cast("double").alias(c) for c in statistics])
            .unpivot(["column_name"], [col(c) for c in statistics], "statistic", "value")
            .withColumn("text", F.lit(None).cast("string"))
        )
    if others:
        cells = []
        for c in others:
            value = col(c) if _orderable(field_type(df, c)) else countable(df, c)
            for statistic, number, text in (
                ("count", F.count(value), F.lit(None)),
                ("null_count", F.count_if(value.isNull()), F.lit(None)),
                ("min", F.lit(None), F.min(value)),
                ("max", F.lit(None), F.max(value)),
            ):
                cells.append(
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.lit(statistic).alias("statistic"),
                        number.cast("double").alias("value"),
                        text.cast("string").alias("text"),
                    )
                )
        parts.append(
            df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
        )
    return reduce(DataFrame.unionByName, parts)


def _orderable(data_type: T.DataType) -> bool:
    return not isinstance(data_type, (T.ArrayType, T.MapType, T.StructType))


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: type, distinct values (null is one), missing cells and, for
    numeric columns, mean, median, mode (smallest on ties), sample deviation, min, max.

    One pass of plain aggregates, one shuffle of value counts per kind of type,
    and the median passes; nothing is read once per column.
    """
    require_columns(df, columns)
    numeric = [c for c in columns if is_numeric(field_type(df, c))]
    others = [c for c in columns if c not in numeric]
    parts = []
    if numeric:
        medians = exact_quantiles(df, {c: [0.5] for c in numeric})
        parts.append(
            _numbers(df, numeric)
            .withColumn("median", _by_column({c: medians[c, 0.5] for c in numeric}))
            .select("column_name", F.col("null_count").alias("missing_values"), "mean", "median", "std", "min", "max")
        )
    if others:
        parts.append(
            df.select(*[col(c).isNull().alias(c) for c in others])
            .unpivot([], [col(c) for c in others], "column_name", "gap")
            .groupBy("column_name")
            .agg(F.count_if("gap").alias("missing_values"))
        )
    for names, counts in value_counts_by_column(df, columns):
        cells = [
            F.struct(
                F.lit(c).alias("column_name"),
                F.count_if(F.col("name") == c).alias("unique_values"),
                (most_frequent(c) if c in numeric else F.lit(None)).cast("double").alias("mode"),
            )
            for c in names
        ]
        parts.append(counts.agg(F.array(*cells).alias("cells")).select(F.inline("cells")))
    united = _together(df, columns, parts)
    types = F.create_map(*[F.lit(x) for c in columns for x in (c, field_type(df, c).simpleString())])
    number = lambda m: (F.col(m) if m in united.columns else F.lit(None).cast("double")).alias(m)
    return united.select(
        "column_name",
        types[F.col("column_name")].alias("data_type"),
        F.coalesce("unique_values", F.lit(0)).alias("unique_values"),
        F.coalesce("missing_values", F.lit(0)).alias("missing_values"),
        *[number(m) for m in ("mean", "median", "mode", "std", "min", "max")],
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``(<column>, count)``; null is a value."""
    require_columns(df, [column])
    return df.groupBy(col(column)).agg(F.count(F.lit(1)).alias("count"))


def filter_options(df: DataFrame, fewer_than: int = 100) -> DataFrame:
    """``(column_name, value)``: the distinct values of every column with few of them, from one pass."""
    return few_values(df, fewer_than)


def overview(df: DataFrame, rows: int = 5, order_by: list[str] | None = None) -> dict[str, DataFrame]:
    """What one looks at before choosing a model: first rows (in an order, if one is given), summary, statistics."""
    return {"head": head(df, rows, order_by), "summary": dataset_summary(df), "statistics": describe(df)}
