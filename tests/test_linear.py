"""Regression from moments against refits, importance of any model, contracts of score tables."""

from __future__ import annotations

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.columns import MissingColumn
from tabloom.ml import contract, dictionary, evaluate, linear, stacking
from tabloom.ml.split import fold
from tabloom.operators import encode


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(500):
        a, b = float(rng.normal(1e4, 50)), float(rng.normal())
        rows.append((i, a, None if i % 7 == 0 else b, 3.0, 2 * a - 5 * b + float(rng.normal())))
    return spark.createDataFrame(rows, "id bigint, a double, b double, same double, y double").repartition(5)


def refit(x, y, penalty):
    mean, top = x.mean(0), y.mean()
    s = (x - mean).T @ (x - mean)
    w = np.linalg.lstsq(s + penalty * np.diag(np.diag(s)), (x - mean).T @ (y - top), rcond=None)[0]
    return lambda z: top + (z - mean) @ w


def test_leaderboard_equals_refits_of_every_fold(spark, noisy):
    found = {r.penalty: r.mse for r in linear.leaderboard(spark, linear.moments(noisy, ["a", "b", "same"], "y", "id")).collect()}
    frame = noisy.withColumn("fold", fold("id", 5)).toPandas()
    frame["b"] = frame["b"].fillna(frame["b"].mean())
    x, y = frame[["a", "b", "same"]].to_numpy(), frame["y"].to_numpy()
    for penalty, mse in found.items():
        error = 0.0
        for f in range(5):
            held = (frame["fold"] == f).to_numpy()
            error += ((y[held] - refit(x[~held], y[~held], penalty)(x[held])) ** 2).sum()
        assert mse == pytest.approx(error / len(y), rel=1e-6)
    assert sorted(found) == sorted(linear.PENALTIES)


def test_model_predicts_and_survives_saving(spark, noisy, tmp_path):
    trained = linear.model(linear.moments(noisy, ["a", "b", "same"], "y", "id"), 0.0)
    assert trained.coefficients[0] == pytest.approx(2, abs=0.02) and trained.coefficients[2] == 0
    again = linear.load(spark, linear.save(spark, trained, f"{tmp_path}/m"))
    assert again == trained
    metrics = evaluate.regression_metrics(again.predict(noisy), "y", "predict").first()
    assert metrics.n == 500 and metrics.r2 > 0.99
    assert [r.variable for r in linear.importance(spark, trained).collect()] == ["a", "b", "same"]


def test_rows_without_target_or_with_endless_values_are_left_out(spark):
    rows = [(i, float(i), 2.0 * i) for i in range(20)] + [(30, 5.0, None), (31, math.inf, 1.0), (32, 5.0, math.nan), (33, None, 19.0), (34, 1.0, -math.inf)]
    found = linear.moments(spark.createDataFrame(rows, "id bigint, x double, y double"), ["x"], "y", "id")
    assert found.total[0, 0] == 21
    empty = linear.moments(spark.createDataFrame([], "id bigint, x double, y double"), ["x"], "y", "id")
    assert linear.leaderboard(spark, empty).count() == 0
    with pytest.raises(ValueError):
        linear.model(empty, 0.1)


def test_one_fold_is_predicted_by_its_mean(spark):
    found = linear.moments(spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 3.0)], "id bigint, x double, y double"), ["x"], "y", "id")
    assert linear.leaderboard(spark, found, [0.0]).first().mse == pytest.approx(1.0)


def test_rotation_is_a_permutation_of_every_ring(spark):
    df = spark.range(1000).select("id", (F.col("id") * 2).alias("v"))
    out = linear.rotated(df, ["v"], "id", rows_per_range=100).collect()
    assert sorted(r._rotated.f0 for r in out) == sorted(r.v for r in out)
    assert sum(r._rotated.f0 == r.v for r in out) < 10
    assert linear.rotated(df.limit(0), ["v"], "id").count() == 0


def test_importance_of_a_family_without_coefficients(spark):
    """A family without coefficients: the feature that makes the target matters, noise does not."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(600).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.xxhash64("id") % 10).cast("double").alias("noise")).withColumn("label", (F.col("x") > 4).cast("double"))
    fitted = Pipeline(stages=[VectorAssembler(inputCols=["x", "noise"], outputCol="features"), NaiveBayes(modelType="gaussian", predictionCol="predict")]).fit(df)
    loss = (F.col("label") != F.col("predict")).cast("double")
    found = {r.variable: r.importance for r in linear.permutation_importance(fitted.transform, df, ["x", "noise"], "label", "id", loss=loss).collect()}
    assert found["x"] > 0.3 and abs(found["noise"]) < 0.05


@pytest.fixture(scope="module")
def learnt(spark, tmp_path_factory):
    df = spark.createDataFrame([(float(i), "ab"[i % 2], None, i) for i in range(100)], "x double, t string, gone double, n int")
    path = str(tmp_path_factory.mktemp("contract"))
    return contract.load(spark, contract.save(spark, contract.learn(df, ["x", "t", "gone", "n"]), path))


def test_contract_counts_what_is_new(spark, learnt):
    rows = [(float(i), "abc"[i % 3], None, i) for i in range(90)] + [(500.0, None, 1.0, None), (None, "d", None, -1)]
    found = {r.column_name: r for r in contract.checks(learnt, spark.createDataFrame(rows, "x double, t string, gone double, n bigint")).collect()}
    assert {c: (r.rows, r.missing, r.unseen) for c, r in found.items()} == {"x": (92, 1, 1), "t": (92, 1, 31), "gone": (92, 91, 1), "n": (92, 1, 1)}
    assert found["t"]["shift"] is None and found["gone"]["shift"] is None and found["x"]["shift"] > 0
    same = contract.checks(learnt, spark.createDataFrame([(float(i), "ab"[i % 2], None, i) for i in range(100)], "x double, t string, gone double, n int"))
    assert {r.column_name: (r.unseen, r["shift"]) for r in same.collect()} == {"x": (0, 0.0), "t": (0, None), "gone": (0, None), "n": (0, 0.0)}


def test_contract_guards(spark, learnt):
    with pytest.raises(MissingColumn):
        contract.checks(learnt, spark.createDataFrame([(1.0, "a")], "x double, t string"))
    with pytest.raises(TypeError, match="'x' is string"):
        contract.checks(learnt, spark.createDataFrame([("1", "a", 1.0, 1)], "x string, t string, gone double, n int"))
    with pytest.raises(MissingColumn):
        contract.score_table(learnt, lambda d: d, spark.createDataFrame([(1.0, "a", 1.0, 1)], "x double, t string, gone double, n int"), "actual", [])
    empty = contract.checks(learnt, spark.createDataFrame([], "x double, t string, gone double, n int"))
    assert {(r.rows, r.missing, r.unseen) for r in empty.collect()} == {(0, 0, 0)}


def test_dictionary_numbers_values_of_all_text_columns(spark):
    rows = [(i, f"w{i % 900:04d}" + "x" * 200 if i % 11 else None, "ab"[i % 2], i % 3 == 0, None if i % 5 == 0 else float(i), i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, word string, t string, flag boolean, x double, y bigint").repartition(6)
    found = dictionary.learn(df, "y", leave_out=("id",))
    words = sorted({r[1] for r in rows if r[1]})
    assert found.size == 2 + len(words) + 2
    assert [tuple(r) for r in found.values.orderBy("slot").collect()] == [(0, w, 2 + i) for i, w in enumerate(words)] + [(1, "a", 2 + len(words)), (1, "b", 3 + len(words))]
    fresh = spark.createDataFrame([(1, words[5], "b", True, None), (2, "unseen", None, None, 4.0)], "id bigint, word string, t string, flag boolean, x double")
    out = {r.id: r for r in dictionary.encode(fresh, found).withColumn("v", dictionary.as_vector("features")).collect()}
    mean = sum(r[4] for r in rows if r[4] is not None) / sum(r[4] is not None for r in rows)
    assert list(out[1].features.indices) == [0, 1, 7, 3 + len(words)] and out[1].features["values"] == [1.0, pytest.approx(mean), 1.0, 1.0]
    assert list(out[2].features.indices) == [0, 1] and out[2].features["values"] == [pytest.approx(667 / 2000), 4.0]
    assert out[1].v.size == found.size and out[1].v[7] == 1.0


def test_dictionary_edges(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 3.0)], "id bigint, t string, y double")
    found = dictionary.learn(df, "y")
    assert found.size == 1 and [r.features.indices for r in dictionary.encode(df, found).collect()] == [[0], [0]]
    with pytest.raises(TypeError, match="m "):
        dictionary.learn(spark.createDataFrame([({"a": 1}, 1)], "m map<string,int>, y int"), "y")
    empty = dictionary.learn(df.limit(0), "y")
    assert empty.size == 1 and dictionary.encode(df.limit(0), empty).count() == 0


def test_categories_of_all_columns_come_from_one_pass(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        reads.add(1)
        return True

    df = spark.range(60).select("id", (F.col("id") % 3).alias("n"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 2).cast("int")).alias("day"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("z"), F.col("id") % 2)).alias("t")).filter(seen("id"))
    found = encode.one_hot_categories(df, ["t", "n", "day"])
    assert reads.value == 60
    assert found == {"t": ["z0", "z1"], "n": [0, 1, 2], "day": [datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)]}
    with pytest.raises(encode.TooManyCategories, match="'n'"):
        encode.one_hot_categories(df, ["t", "n"], 2)


def test_stack_weighs_every_variant_and_is_not_above_the_best(spark, noisy):
    made = stacking.stack(noisy, ["a", "b"], "y", "id", penalties=[0.0, 0.1, 1.0, 10.0])
    assert len(made.models) == len(made.found.weights) == 4 and min(made.found.weights) >= 0
    assert made.found.loss <= min(made.found.base) + 1e-9
    out = made.predict(noisy)
    assert out.columns == [*noisy.columns, "predict"] and out.filter("predict IS NULL").count() == 0 and out.count() == 500
    frame = stacking.out_of_fold(linear.moments(noisy, ["a", "b"], "y", "id"), noisy, "id", [0.1]).toPandas()
    assert made.found.base[1] == pytest.approx(((frame["y"] - frame["base0"]) ** 2).mean(), rel=1e-9)
    with pytest.raises(ValueError):
        stacking.level_one_weights(noisy.limit(0), ["a"], "y")


def test_nonnegative_weights_are_optimal():
    rng = np.random.default_rng(9)
    for _ in range(30):
        x, y = rng.normal(size=(50, 4)), rng.normal(size=50)
        w = stacking.nonnegative(x.T @ x, x.T @ y)
        slope = x.T @ (x @ w - y)
        assert (w >= 0).all() and (slope > -1e-8).all() and abs(slope[w > 0]).max(initial=0) < 1e-7
    assert stacking.nonnegative(np.zeros((2, 2)), np.zeros(2)).tolist() == [0.0, 0.0]
