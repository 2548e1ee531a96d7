"""A level-one table of out-of-fold predictions of every variant, and weights that are never negative.

Each row is predicted by the solutions that did not see its fold, all variants in one projection. The
weights minimise the squared error of the weighted predictions with an intercept under weights >= 0; they
follow from the centred sums of products of the level-one table, one pass of any width, so the driver
solves a system of as many unknowns as there are variants. As one base model with weight 1 is allowed, the
loss on the level-one table is not above that of the best base model.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import measure
from tabloom.functions.gram import pair_sums
from tabloom.ml import linear
from tabloom.ml.split import fold as fold_of


def out_of_fold(found: linear.Moments, df: DataFrame, key: str, penalties: Iterable[float], folds: int = linear.FOLDS, seed: int = 1) -> DataFrame:
    """``df`` with ``base0``, ``base1``, ... : what each penalty's model predicts without the row's fold."""
    total, k = found.total, len(found.features)
    at = fold_of(key, folds, seed)
    values = [F.coalesce(measure(df, f), F.lit(float(m))) for f, m in zip(found.features, found.means)]
    columns: dict[str, Column] = {}
    for i, penalty in enumerate(penalties):
        solutions = []
        for f in range(folds):
            rest = total - found.by_fold.get(f, np.zeros_like(total))
            solutions.append(linear.solve(rest, penalty) if rest[0, 0] > 0 else np.zeros(k + 1))
        start = [float(found.means[-1] + s[0] - found.means[:k] @ s[1:]) for s in solutions]
        value = F.get(F.array(*map(F.lit, start)), at)
        for j, x in enumerate(values):
            value = value + F.get(F.array(*[F.lit(float(s[1 + j])) for s in solutions]), at) * x
        columns[f"base{i}"] = value
    return df.withColumns(columns)


def nonnegative(products: np.ndarray, aims: np.ndarray, rounds: int = 100_000) -> np.ndarray:
    """The w >= 0 that minimises w'Pw - 2 a'w, one unknown after another until none moves."""
    w = np.zeros(len(aims))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            if products[j, j] > 0:
                w[j] = max(0.0, w[j] + (aims[j] - products[j] @ w) / products[j, j])
        if np.abs(w - before).max(initial=0.0) <= 1e-13 * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w


@dataclass(frozen=True)
class Weights:
    """``loss`` is the mean squared error on the level-one table, ``base`` that of each variant alone."""

    intercept: float
    weights: list[float]
    loss: float
    base: list[float]


def level_one_weights(level_one: DataFrame, columns: list[str], target: str) -> Weights:
    """Weights of the variants from rows that have all predictions and the target."""
    names = [*columns, target]
    whole = level_one.dropna(subset=names)
    sums, means = pair_sums(whole, names)
    n, k = sums.n[0, 0], len(columns)
    if not n:
        raise ValueError("no row has all predictions and the target")
    mean = np.array(means) + np.diag(sums.s) / n
    centred = sums.xy - np.outer(np.diag(sums.s), np.diag(sums.s)) / n
    w = nonnegative(centred[:k, :k], centred[:k, k])
    loss = (centred[k, k] - 2 * w @ centred[:k, k] + w @ centred[:k, :k] @ w) / n
    base = [(centred[k, k] - 2 * centred[i, k] + centred[i, i]) / n + (mean[k] - mean[i]) ** 2 for i in range(k)]
    return Weights(float(mean[k] - mean[:k] @ w), w.tolist(), float(max(loss, 0.0)), [float(max(b, 0.0)) for b in base])


@dataclass(frozen=True)
class Stacked:
    """The weighted sum of the models of all folds."""

    models: list[linear.LinearModel]
    found: Weights

    def predict(self, df: DataFrame, name: str = "predict") -> DataFrame:
        value, out = F.lit(self.found.intercept), df
        parts = [f"__tabloom_base{i}" for i in range(len(self.models))]
        for part, model, weight in zip(parts, self.models, self.found.weights):
            out = model.predict(out, part)
            value = value + F.lit(weight) * F.col(part)
        return out.withColumn(name, value).drop(*parts)


def stack(df: DataFrame, features: list[str], target: str, key: str, penalties: Iterable[float] = linear.PENALTIES, folds: int = linear.FOLDS, seed: int = 1) -> Stacked:
    """Every penalty is a variant, and none is left out."""
    penalties = list(penalties)
    found = linear.moments(df, features, target, key, folds, seed)
    level_one = out_of_fold(found, df, key, penalties, folds, seed)
    weights = level_one_weights(level_one, [f"base{i}" for i in range(len(penalties))], target)
    return Stacked([linear.model(found, p) for p in penalties], weights)
