"""The selectable column types and the casts between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.columns import col, field_type

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


@dataclass(frozen=True)
class ColumnType:
    spark: str  # DDL text of the Spark type
    maximum: int | None = None  # upper bound of an unsigned type


# The type names a user can pick and what each one is in Spark.
# Spark has no unsigned integers, so those take the next wider type and a
# range check.
TYPES = {
    "Int8": ColumnType("tinyint"),
    "Int16": ColumnType("smallint"),
    "Int32": ColumnType("int"),
    "Int64": ColumnType("bigint"),
    "UInt8": ColumnType("smallint", 2**8 - 1),
    "UInt16": ColumnType("int", 2**16 - 1),
    "UInt32": ColumnType("bigint", 2**32 - 1),
    "UInt64": ColumnType("decimal(20,0)", 2**64 - 1),
    "Float32": ColumnType("float"),
    "Float64": ColumnType("double"),
    "Utf8": ColumnType("string"),
    "String": ColumnType("string"),
    "Boolean": ColumnType("boolean"),
    "Date": ColumnType("date"),
    "Datetime": ColumnType("timestamp_ntz"),
    "Time": ColumnType("time(6)"),
    "Duration": ColumnType("interval day to second"),
    "Categorical": ColumnType("string"),
    "List": ColumnType("array<string>"),
}


def resolve_type(name: str) -> ColumnType:
    try:
        return TYPES[name]
    except KeyError:
        raise ValueError(f"unknown column type '{name}'; choose one of {sorted(TYPES)}") from None


def cast_column(df: DataFrame, name: str, type_name: str, lenient: bool = False) -> Column:
    """Cast one column of ``df``; a bad cell raises, or becomes null when lenient."""
    target = resolve_type(type_name)
    source = field_type(df, name)
    value = col(name)

    if type_name == "List":
        return value.cast("array<string>") if isinstance(source, T.ArrayType) else F.when(
            value.isNotNull(), F.array(value.cast("string"))
        )
    converted = _across_time(value, source, type_name)
    if converted is None:
        converted = value.try_cast(target.spark) if lenient else value.cast(target.spark)
    if target.maximum is None:
        return converted

    in_range = converted.between(F.lit(0), F.lit(str(target.maximum)).cast(target.spark))
    if lenient:
        return F.when(in_range, converted)
    return F.when(converted.isNull() | in_range, converted).otherwise(
        F.raise_error(F.concat(F.lit(f"{name}: value out of range for {type_name}: "), value.cast("string")))
    )


def _across_time(value: Column, source: T.DataType, type_name: str) -> Column | None:
    """Whole numbers to and from times: days for dates, microseconds otherwise."""
    if isinstance(source, T.IntegralType):
        if type_name == "Date":
            return F.date_from_unix_date(value.cast("int"))
        micros = F.make_dt_interval(secs=value.cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(8,0)"))
        if type_name == "Duration":
            return micros
        if type_name == "Datetime":
            return F.expr(EPOCH) + micros
    if type_name == "Int64":
        if isinstance(source, T.DateType):
            return F.unix_date(value).cast("bigint")
        if isinstance(source, T.TimestampNTZType):
            return _interval_micros(value - F.expr(EPOCH))
        if isinstance(source, T.DayTimeIntervalType):
            return _interval_micros(value)
    return None


def _interval_micros(interval: Column) -> Column:
    seconds = F.extract(F.lit("SECOND"), interval)
    whole = (
        F.extract(F.lit("DAY"), interval).cast("bigint") * 86_400
        + F.extract(F.lit("HOUR"), interval) * 3_600
        + F.extract(F.lit("MINUTE"), interval) * 60
    )
    return whole * 1_000_000 + (seconds * 1_000_000).cast("bigint")
