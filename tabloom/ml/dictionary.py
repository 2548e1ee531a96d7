"""Sparse features of all columns, with the values of text columns numbered by a dictionary table.

The distinct values of all text columns come from one pass and one shuffle. They are dealt by ranges of
(column, value), written with the number of their range, numbered inside it and shifted by the sizes of
the ranges before, so neither a task nor the driver holds them all. Rows meet the dictionary in a join a
column (broadcast where it is small), and each row's slots become one sparse vector; nothing is as wide
as the dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabloom.functions.columns import col, require_columns
from tabloom.functions.scratch import written
from tabloom.ml.features import _as_number
from tabloom.operators.merge import merge

#: So many characters of a value choose its range.
RANGE_KEY = 128
_VALUE, _SLOT = "__tabloom_value", "__tabloom_slot"


@dataclass(frozen=True)
class Dictionary:
    """``numbers`` (name, expression, mean) take the first slots; ``values`` is ``(column, value, slot)``."""

    numbers: tuple[tuple[str, str, float], ...]
    texts: tuple[str, ...]
    values: DataFrame
    size: int


def learn(df: DataFrame, target: str, leave_out: tuple[str, ...] = ()) -> Dictionary:
    """Numbers (also booleans, dates and times) and texts but the target; other types raise unless left out."""
    require_columns(df, [target, *leave_out])
    fields = [f for f in df.schema.fields if f.name not in (target, *leave_out)]
    shown = {f.name: f"NULLIF({e}, CAST('NaN' AS DOUBLE))" for f in fields if (e := _as_number(f.name, f.dataType))}
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    other = [f"{f.name} ({f.dataType.simpleString()})" for f in fields if f.name not in shown and f.name not in texts]
    if other:
        raise TypeError(f"no feature can be made of {', '.join(other)}; leave them out")
    means = df.agg(*[F.avg(F.expr(e)) for e in shown.values()]).first() if shown else ()
    cells = F.array(*[F.struct(F.lit(i).alias("column"), col(c).alias("value")) for i, c in enumerate(texts)])
    if not texts:
        cells = F.array().cast("array<struct<column:int,value:string>>")
    distinct = df.select(F.inline(cells)).filter("value IS NOT NULL").distinct()
    dealt = distinct.repartitionByRange("column", F.substring("value", 1, RANGE_KEY)).withColumn("range", F.spark_partition_id())
    ranged = written(dealt, "dictionary")
    counts = ranged.groupBy("range").count()
    # one row a range
    before = counts.select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("column", "value")) - 1
    numbered = ranged.withColumn("place", place).join(F.broadcast(before), "range")
    values = written(numbered.select("column", "value", (F.col("before") + F.col("place") + len(shown)).cast("int").alias("slot")), "dictionary-slots")
    return Dictionary(
        tuple((n, e, 0.0 if m is None else float(m)) for (n, e), m in zip(shown.items(), means)), tuple(texts), values, len(shown) + values.count()
    )


def encode(df: DataFrame, dictionary: Dictionary, name: str = "features") -> DataFrame:
    """``df`` with ``indices`` and ``values`` of its sparse features in one struct: every number (the mean of
    the training table for a missing one), and 1 in the slot of every text that the dictionary knows."""
    require_columns(df, [*[n for n, _, _ in dictionary.numbers], *dictionary.texts])
    out = df
    for i, c in enumerate(dictionary.texts):
        known = dictionary.values.filter(F.col("column") == i).select(F.col("value").alias(_VALUE), F.col("slot").alias(f"{_SLOT}{i}"))
        out = merge(out.withColumn(_VALUE, col(c)), known, _VALUE, "left").drop(_VALUE)
    numbers = [F.struct(F.lit(i).alias("i"), F.coalesce(F.expr(e), F.lit(m)).alias("v")) for i, (_, e, m) in enumerate(dictionary.numbers)]
    slots = [F.struct(F.col(f"{_SLOT}{i}").alias("i"), F.lit(1.0).alias("v")) for i in range(len(dictionary.texts))]
    cells = F.filter(F.array(*numbers, *slots), lambda x: x["i"].isNotNull())  # slots of later columns are larger
    sparse = F.struct(F.lit(dictionary.size).alias("size"), F.transform(cells, lambda x: x["i"]).alias("indices"), F.transform(cells, lambda x: x["v"]).alias("values"))
    return out.select(*[col(c) for c in df.columns], sparse.alias(name))


@F.udf(VectorUDT())
def as_vector(features):
    """The struct as Spark ML takes it."""
    return SparseVector(features.size, features.indices, features["values"])
