"""Sums over all pairs of columns, each over the rows where both are present, from matrix products.

A task keeps four k x k matrices, whatever the number of its rows: with the mask M of present values and
X the values with 0 for missing ones, M'M counts the common rows, X'M and (X*X)'M are the sums and squares
of a column over the rows its partner has, and X'X the sums of products. The matrices of all tasks are
added cell by cell in Spark; the driver gets k x k cells.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.functions.columns import col, measure


class PairSums(NamedTuple):
    """``n[i, j]`` common rows; ``s[i, j]``, ``ss[i, j]`` of column i over them; ``xy[i, j]``: products."""

    n: np.ndarray
    s: np.ndarray
    ss: np.ndarray
    xy: np.ndarray


_CELL = "i int, j int, " + ", ".join(f"{name} double" for name in PairSums._fields)


def _products(means: list[float]):
    shift = np.array(means)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shift)
        total = np.zeros((len(PairSums._fields), k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - shift
            there = ~np.isnan(x)
            endless = np.isinf(x)
            x[~there | endless] = 0.0
            mask, squares = there.astype(float), x * x
            total += np.stack([mask.T @ mask, x.T @ mask, squares.T @ mask, x.T @ x])
            if endless.any():  # a pair that meets an infinite value has no finite sums
                met = endless.astype(float).T @ mask > 0
                total[1:, met | met.T] = np.nan
        if total[0].any():
            i, j = np.indices((k, k)).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *[pa.array(t.ravel()) for t in total]], ["i", "j", *PairSums._fields])

    return run


def pair_sums(df: DataFrame, columns: list[str]) -> tuple[PairSums, list[float]]:
    """The sums of the columns less their means, which keeps the sums from cancelling, and the means."""
    x = [measure(df, c) for c in columns]
    means = [m if m is not None and np.isfinite(m) else 0.0 for m in df.agg(*[F.avg(v) for v in x]).first()]
    # Arrow hands nulls over as NaN, and NaN is missing too
    values = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    cells = values.mapInArrow(_products(means), _CELL).groupBy("i", "j").agg(*[F.sum(name).alias(name) for name in PairSums._fields])
    out = PairSums(*np.zeros((len(PairSums._fields), len(columns), len(columns))))
    for r in cells.collect():
        for name, matrix in zip(PairSums._fields, out):
            matrix[r["i"], r["j"]] = r[name]
    return out, means
