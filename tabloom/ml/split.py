"""Repeatable train / validation / test splits and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import col, require_columns
from tabloom.functions.hashing import hash32

# Shares of the three parts in percent
SHARES = {"train": 70, "validation": 15, "test": 15}


def with_part(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """Add ``part``: a row's part depends on its key and the seed only."""
    require_columns(df, [key])
    bucket = hash32(col(key), seed) % 100
    part: Column = F.lit("test")
    upto = SHARES["train"] + SHARES["validation"]
    part = F.when(bucket < SHARES["train"], "train").when(bucket < upto, "validation").otherwise(part)
    return df.withColumn("part", part)


def split(df: DataFrame, key: str, seed: int = 1) -> dict[str, DataFrame]:
    parted = with_part(df, key, seed)
    return {name: parted.filter(F.col("part") == name).drop("part") for name in SHARES}


def fold(key: str, folds: int, seed: int = 1) -> Column:
    """Fold number of a row, independent of the split above."""
    return (hash32(col(key), f"fold {seed}") % folds).cast("int")
