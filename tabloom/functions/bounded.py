"""Distinct values of all columns in one pass, given up where a column has too many.

Each task keeps a set of values per column that stops growing at a limit and then remembers only that
it has overflowed, so memory and what leaves a task are bounded by the number of columns times the
limit, whatever the data. Sets of tasks are united by an ordinary distinct.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.columns import field_type
from tabloom.functions.stats import countable

_PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _value(df: DataFrame, name: str) -> Column:
    value = countable(df, name)
    return value if isinstance(field_type(df, name), _PLAIN) else value.cast("string")


def _sets(limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Array | None] | None = None
        schema = None
        for batch in batches:
            if kept is None:
                schema, kept = batch.schema, [c.slice(0, 0) for c in batch.columns]
            for i, column in enumerate(batch.columns):
                if kept[i] is not None:
                    united = pc.unique(pa.concat_arrays([kept[i], pc.unique(column)]))
                    kept[i] = united if len(united) < limit else None
        if kept is None:
            return
        sizes = [-1 if s is None else len(s) for s in kept]
        rows = max(1, *sizes)
        columns = [
            pa.nulls(rows, f.type) if s is None else pa.concat_arrays([s, pa.nulls(rows - len(s), f.type)]) for s, f in zip(kept, schema)
        ]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(range(rows), pa.int32()), pa.array([sizes] * rows, pa.list_(pa.int32()))], [*schema.names, "row", "sizes"])

    return run


def few_values(df: DataFrame, fewer_than: int) -> DataFrame:
    """``(column_name, value)`` as texts for every column with fewer distinct values; null is a value."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column_name string, value string")
    names = [f"c{i}" for i in range(len(df.columns))]
    raw = df.select(*[_value(df, c).alias(n) for n, c in zip(names, df.columns)])
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in raw.schema.fields], T.StructField("row", T.IntegerType()), T.StructField("sizes", T.ArrayType(T.IntegerType()))])
    sets = raw.mapInArrow(_sets(fewer_than), schema)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(n).cast("string").alias("value"), F.col("sizes")[i].alias("size")) for i, (n, c) in enumerate(zip(names, df.columns))])
    values = sets.select("row", F.inline(cells)).filter((F.col("size") < 0) | (F.col("row") < F.col("size")))
    united = values.groupBy("column_name", "value").agg(F.bool_or(F.col("size") < 0).alias("over"))
    few = united.groupBy("column_name").agg(F.bool_or("over").alias("over"), F.count(F.lit(1)).alias("n")).filter(~F.col("over") & (F.col("n") < fewer_than))
    # one row per column at most
    return united.join(F.broadcast(few.select("column_name")), "column_name", "left_semi").select("column_name", "value")
