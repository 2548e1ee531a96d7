"""The ten-column sample table, one row per key."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.functions.columns import col
from tabloom.functions.hashing import hash32, uniform


def _pick(key: Column, seed: str, values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])[hash32(key, seed) % len(values)]


def sample_columns(keys: DataFrame, key: str, today: datetime.date, seed: int = 1) -> DataFrame:
    """A sample row for every row of ``keys``.

    Each value is a hash of the key, the seed and the column, so neither the
    partitioning nor a rerun changes the table.
    """
    k = col(key)
    at = lambda name: f"{seed}:{name}"
    u, v = uniform(k, at("normal u")), uniform(k, at("normal v"))
    # two uniforms make a normal; 1 - u is never zero
    normal = 50.0 + 10.0 * F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(F.lit(2.0) * F.pi() * v)
    second = (hash32(k, at("time")) % 86_400).cast("int")
    clock = F.concat_ws(
        ":",
        *[F.lpad(part.cast("string"), 2, "0") for part in (F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)],
    )
    # Names, texts and ranges of the sample table's columns
    return keys.select(
        F.concat(F.lit("String_"), k.cast("string")).alias("StringColumn"),
        (uniform(k, at("float")) * 100.0).alias("Float64Column"),
        F.concat(F.lit("Category_"), _pick(k, at("category"), ["A", "B", "C"])).alias("CategoryColumn"),
        F.date_sub(F.lit(today), (hash32(k, at("date")) % 366).cast("int")).alias("DateColumn"),
        (hash32(k, at("boolean")) % 2 == 0).alias("BooleanColumn"),
        (hash32(k, at("int")) % 100 + 1).cast("int").alias("AdditionalColumn1"),
        F.concat(F.lit("Extra_"), k.cast("string")).alias("AdditionalColumn2"),
        normal.alias("AdditionalColumn3"),
        clock.alias("AdditionalColumn4"),
        _pick(k, at("letter"), ["X", "Y", "Z"]).alias("AdditionalColumn5"),
    )


def sample_table(spark: SparkSession, rows: int = 100, seed: int = 1, today: datetime.date | None = None) -> DataFrame:
    return sample_columns(spark.range(rows), "id", today or datetime.date.today(), seed)
