"""Repeatable pseudo-random numbers from a key, the same on every engine and run."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash32(key: Column, seed: int | str) -> Column:
    """0 .. 2^32 - 1 from the key's text and the seed."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(key: Column, seed: int | str) -> Column:
    """[0, 1) from the key and the seed."""
    return hash32(key, seed) / F.lit(float(2**32))
