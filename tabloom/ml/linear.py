"""Ridge regression whose cross-validation needs no further pass over the rows.

One pass gives the moments of each fold: the matrix of sums of products of (1, features, target). The
moments of all rows but a fold are the difference of two such matrices, so every penalty on every fold
is the solution of a small system, and the squared error on a held-out fold is a quadratic form of its
moments. The leaderboard of any number of penalties costs the two passes that one model costs.

The penalty of a feature is relative to its spread: with centred sums S, coefficients solve
(S + penalty * diag(S)) b = S_y, so it does not depend on units. Missing features count as their mean
over the training table; rows without target or with an infinite value are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabloom.functions.columns import col, measure, require_columns
from tabloom.functions.hashing import hash32
from tabloom.ml.split import fold as fold_of

PENALTIES = (0.0, 0.001, 0.01, 0.1, 1.0, 10.0)
FOLDS = 5


@dataclass(frozen=True)
class Moments:
    """Sums of products of (1, features..., target) less their ``means``, by fold."""

    features: tuple[str, ...]
    target: str
    means: np.ndarray
    by_fold: dict[int, np.ndarray]

    @property
    def total(self) -> np.ndarray:
        size = len(self.means) + 1
        return sum(self.by_fold.values(), np.zeros((size, size)))


@dataclass(frozen=True)
class LinearModel:
    """``predict`` = intercept + sum of coefficients times values, means in the place of missing ones.
    ``deviations`` are the features' standard deviations in the training table."""

    features: list[str]
    target: str
    penalty: float
    intercept: float
    coefficients: list[float]
    means: list[float]
    deviations: list[float]

    def predict(self, df: DataFrame, name: str = "predict") -> DataFrame:
        require_columns(df, self.features)
        value = F.lit(self.intercept)
        for feature, weight, mean in zip(self.features, self.coefficients, self.means):
            value = value + F.lit(weight) * F.coalesce(measure(df, feature), F.lit(mean))
        return df.withColumn(name, value)


def moments(df: DataFrame, features: list[str], target: str, key: str, folds: int = FOLDS, seed: int = 1) -> Moments:
    """Two passes: the means, and the moments of each fold, added over tasks in Spark."""
    names = [*features, target]
    require_columns(df, [*names, key])
    finite = lambda v: F.when(F.abs(v) < float("inf"), v)
    y = finite(measure(df, target))
    endless = [F.coalesce(F.abs(measure(df, f)) == float("inf"), F.lit(False)) for f in features]
    rows = df.filter(y.isNotNull())
    for bad in endless:
        rows = rows.filter(~bad)
    values = rows.select(fold_of(key, folds, seed).alias("fold"), *[measure(df, n).alias(f"x{i}") for i, n in enumerate(names)])
    means = np.array([m or 0.0 for m in values.agg(*[F.avg(f"x{i}") for i in range(len(names))]).first()])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            part = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).astype(float) - means
            x[np.isnan(x)] = 0.0  # the mean
            x = np.column_stack([np.ones(len(x)), x])
            for f in np.unique(part).tolist():
                mine = x[part == f]
                kept[f] = kept.get(f, 0.0) + mine.T @ mine
        for f, m in kept.items():
            i, j = np.indices(m.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), f, np.int32)), pa.array(i), pa.array(j), pa.array(m.ravel())], ["fold", "i", "j", "v"])

    cells = values.mapInArrow(run, "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    by_fold: dict[int, np.ndarray] = {}
    for r in cells.collect():  # folds * (features + 2)^2 numbers
        by_fold.setdefault(r["fold"], np.zeros((len(names) + 1,) * 2))[r["i"], r["j"]] = r["v"]
    return Moments(tuple(features), target, means, by_fold)


def solve(sums: np.ndarray, penalty: float) -> np.ndarray:
    """(intercept, coefficients...) for centred values; a feature without spread gets 0."""
    n, k = sums[0, 0], len(sums) - 2
    centred = sums[1:, 1:] - np.outer(sums[1:, 0], sums[0, 1:]) / n
    s, sy = centred[:k, :k], centred[:k, k]
    spread = np.diag(s) > 1e-12 * np.maximum(np.diag(sums)[1 : k + 1], 1e-300)
    b = np.zeros(k)
    if spread.any():
        inner = s[np.ix_(spread, spread)]
        b[spread] = np.linalg.lstsq(inner + penalty * np.diag(np.diag(inner)), sy[spread], rcond=None)[0]
    return np.concatenate([[(sums[0, -1] - sums[0, 1:-1] @ b) / n], b])


def squared_error(sums: np.ndarray, solution: np.ndarray) -> float:
    """Sum of squared errors of a solution over the rows the moments stand for."""
    w = np.concatenate([solution, [-1.0]])
    return max(float(w @ sums @ w), 0.0)


def leaderboard(spark: SparkSession, found: Moments, penalties: Iterable[float] = PENALTIES) -> DataFrame:
    """``(model_id, penalty, mse, rmse, r2)`` over the held-out folds, best first."""
    total, rows = found.total, []
    n = total[0, 0]
    variance = (total[-1, -1] - total[0, -1] ** 2 / n) / n if n else 0.0
    for penalty in penalties if n else ():
        error = 0.0
        for held in found.by_fold.values():
            rest = total - held
            # a fold that holds all rows is predicted by the mean it is centred at
            error += squared_error(held, solve(rest, penalty) if rest[0, 0] > 0 else np.zeros(len(total) - 1))
        mse = float(error / n)
        rows.append((f"Ridge_{penalty:g}", float(penalty), mse, mse**0.5, float(1 - mse / variance) if variance > 0 else float(mse == 0)))
    rows.sort(key=lambda r: (r[2], r[1]))
    return spark.createDataFrame(rows, "model_id string, penalty double, mse double, rmse double, r2 double")


def model(found: Moments, penalty: float) -> LinearModel:
    """The model of all folds."""
    total, k = found.total, len(found.features)
    if not total[0, 0]:
        raise ValueError("no row has a target")
    solution = solve(total, penalty)
    mean, means = found.means[-1], found.means[:k]
    variance = np.diag(total)[1 : k + 1] / total[0, 0] - (total[0, 1 : k + 1] / total[0, 0]) ** 2
    intercept = float(mean + solution[0] - means @ solution[1:])
    return LinearModel(
        list(found.features), found.target, float(penalty), intercept, solution[1:].tolist(), means.tolist(), np.sqrt(np.maximum(variance, 0)).tolist()
    )


def importance(spark: SparkSession, trained: LinearModel) -> DataFrame:
    """``(variable, importance, share)``: sizes of the standardised coefficients, largest first."""
    sizes = [abs(c) * d for c, d in zip(trained.coefficients, trained.deviations)]
    total = sum(sizes) or 1.0
    rows = sorted(((f, s, s / total) for f, s in zip(trained.features, sizes)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "variable string, importance double, share double")


def save(spark: SparkSession, trained: LinearModel, path: str) -> str:
    spark.createDataFrame([(json.dumps(asdict(trained)),)], "model string").coalesce(1).write.mode("overwrite").text(path)
    return path


def load(spark: SparkSession, path: str) -> LinearModel:
    return LinearModel(**json.loads(spark.read.text(path).first()[0]))


# -- importance for any model -------------------------------------------------

def rotated(df: DataFrame, features: list[str], key: str, rows_per_range: int = 100_000, seed: int = 1) -> DataFrame:
    """``df`` with ``_rotated``, the features of the next row in the order of a hash of the key.

    The hash range is cut into parts of about ``rows_per_range`` rows and each part is a ring of its own,
    so no window holds the table; equal keys follow each other in the order of their features."""
    require_columns(df, [*features, key])
    parts = max(1, -(-df.count() // rows_per_range))
    hashed = df.withColumn("_hash", hash32(col(key), f"rotate {seed}")).withColumn("_ring", F.floor(F.col("_hash") * parts / F.lit(2**32)))
    values = F.struct(*[col(f).alias(f"f{i}") for i, f in enumerate(features)])
    ring = Window.partitionBy("_ring").orderBy("_hash", col(key), *[col(f) for f in features])
    first = F.first(values).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.lead(F.lit(1)).over(ring).isNull()
    return hashed.withColumn("_rotated", F.when(last, first).otherwise(F.lead(values).over(ring))).drop("_hash", "_ring")


def permutation_importance(predict, df: DataFrame, features: list[str], target: str, key: str, loss: Column | None = None, seed: int = 1, rows_per_range: int = 100_000) -> DataFrame:
    """``(variable, importance)``: how much the mean loss grows when one feature at a time comes from another row.

    ``predict`` turns a table into the same with ``predict`` beside it, whatever the model's family.
    ``loss`` is an expression of the target and ``predict``, the squared error if not given. One job:
    each row is scored once as it is and once for every feature."""
    whole = rotated(df, features, key, rows_per_range, seed)
    variants = F.explode(F.array(*[F.lit(i) for i in range(-1, len(features))]))
    swapped = whole.withColumn("_variant", variants).withColumns(
        {f: F.when(F.col("_variant") == i, F.col(f"_rotated.f{i}")).otherwise(col(f)) for i, f in enumerate(features)}
    ).drop("_rotated")
    gap = col(target) - F.col("predict")
    scored = predict(swapped).groupBy("_variant").agg(F.avg(gap * gap if loss is None else loss).alias("loss"))
    base = F.max(F.when(F.col("_variant") < 0, F.col("loss")))
    grid = scored.agg(base.alias("base"), F.collect_list(F.struct("_variant", "loss")).alias("all"))  # one row a feature
    names = F.array(*[F.lit(f) for f in features])
    return (
        grid.select("base", F.explode("all").alias("one")).filter(F.col("one._variant") >= 0)
        .select(names[F.col("one._variant")].alias("variable"), (F.col("one.loss") - F.col("base")).alias("importance"))
    )
