"""Training, scoring and the metrics of both tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabloom.ml import evaluate, features, train
from tabloom.ml.features import CLASSIFICATION, REGRESSION
from tabloom.session import scratch_path


@pytest.fixture(scope="module")
def learnable(spark):
    """A number, a text with gaps and a boolean decide both targets."""
    x = (F.col("id") * 37 % 101).cast("double")
    return spark.range(600).select(
        "id",
        F.when(F.col("id") % 17 > 0, x).alias("x"),
        F.when(F.col("id") % 13 > 0, F.concat(F.lit("g"), F.col("id") % 3)).alias("group"),
        (F.col("id") % 2 == 0).alias("even"),
        (x * 3 + F.col("id") % 3 * 10).alias("amount"),
        F.when(x > 50, "high").otherwise("low").alias("level"),
        F.concat(F.lit("c"), F.floor(x / 34)).alias("three"),
    )


def test_regression(spark, learnable):
    run = train.train(learnable.drop("level", "three"), "amount", REGRESSION, "id", ["GLM", "DRF"], max_models=3)
    board = run.leaderboard(spark).collect()
    assert len(board) == 3 and [r["rmse"] for r in board] == sorted(r["rmse"] for r in board)
    assert run.best().model_id == board[0]["model_id"] and board[0]["r2"] > 0.8
    scored = train.predict(run.best(), run.test)
    assert scored.columns == [*run.test.columns, "predict"] and scored.count() == run.test.count()
    weights = train.feature_importance(run, run.model("GLM_1"), spark).collect()
    assert weights[0]["variable"] == "fill_x" and sum(w["share"] for w in weights) == pytest.approx(1.0)


def test_classification_with_a_stack(spark, learnable):
    table = learnable.drop("amount", "three")
    run = train.train(table, "level", CLASSIFICATION, "id", ["GLM", "NaiveBayes", train.STACKED], max_models=3)
    assert [m.family for m in run.models] == ["GLM", "NaiveBayes", train.STACKED]
    board = run.leaderboard(spark).collect()
    assert all(r["auc"] > 0.9 and 0 <= r["mean_per_class_error"] <= 1 for r in board)
    stacked = run.model("StackedEnsemble_1")
    path = train.save_model(stacked, scratch_path(spark, "stack"))
    unlabelled = run.test.drop("level")
    before = sorted(train.predict(stacked, run.test).select("id", "predict").collect())
    after = sorted(train.load_model(path).transform(unlabelled).select("id", "predict").collect())
    assert before == after and {p for _, p in after} == {"high", "low"}
    assert train.feature_importance(run, stacked, spark).count() == 0


def test_three_classes_boosted(spark, learnable):
    run = train.train(learnable.drop("amount", "level"), "three", CLASSIFICATION, "id", ["GBM", "DeepLearning"], max_models=2)
    board = {r["family"]: r for r in run.leaderboard(spark).collect()}
    assert board["GBM"]["accuracy"] > 0.8 and board["GBM"]["auc"] is None and board["GBM"]["logloss"] is None
    assert board["DeepLearning"]["logloss"] is not None


def test_wrong_task_and_family(learnable):
    with pytest.raises(ValueError):
        train.train(learnable, "level", "ranking", "id")
    with pytest.raises(ValueError):
        train.train(learnable, "amount", REGRESSION, "id", ["NaiveBayes"])


def test_text_is_hashed_on_request_only(spark):
    df = spark.range(600).select("id", F.md5(F.col("id").cast("string")).alias("t"), (F.col("id") % 2).alias("y"))
    prepared = features.feature_pipeline(df, "y", leave_out=("id",), hashed=("t",)).fit(df).transform(df)
    assert len(features.feature_names(prepared)) == features.HASHED_FEATURES
    prepared = features.feature_pipeline(df, "y", leave_out=("id",)).fit(df).transform(df)
    assert len(features.feature_names(prepared)) >= 600


def test_feature_cells(spark):
    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS empty, TIMESTAMP '1970-01-01 00:00:01.5' AS at, v, 0 AS y FROM VALUES (1.0D), (3.0D), (NULL), (DOUBLE('NaN')) t(v)")
    prepared = features.feature_pipeline(df, "y").fit(df).transform(df)
    assert sorted(tuple(r["features"].toArray()) for r in prepared.collect()) == [(0.0, 1.5, 1.0), (0.0, 1.5, 2.0), (0.0, 1.5, 2.0), (0.0, 1.5, 3.0)]
    nested = df.withColumn("list", F.array(F.lit(1)))
    with pytest.raises(TypeError):
        features.feature_pipeline(nested, "y")
    features.feature_pipeline(nested, "y", leave_out=("list",))


def test_regression_metric_edges(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (None, 5.0)], "y double, p double")
    assert tuple(evaluate.regression_metrics(df, "y", "p").first()) == (2, 0.0, 0.0, 0.0, 1.0)
    off = df.withColumn("p", F.lit(2.0))
    assert evaluate.regression_metrics(off, "y", "p").first()["r2"] == 0.0
    assert evaluate.regression_metrics(df.limit(0), "y", "p").first()["r2"] is None


def test_report_of_nothing(spark):
    empty = spark.createDataFrame([], "y string, p string")
    assert evaluate.classification_report(empty, "y", "p").count() == 0
    assert evaluate.confusion_matrix(empty, "y", "p").count() == 0
    assert evaluate.accuracy(empty, "y", "p").first()[0] is None


def test_confusion_of_many_classes(spark):
    df = spark.range(1_100).select(F.col("id").alias("y"), F.col("id").alias("p"))
    found = evaluate.confusion_matrix(df, "y", "p")
    assert tuple(found.agg(F.count("*"), F.sum("count")).first()) == (1_100**2, 1_100)
    assert evaluate.confusion_matrix(df, "y", "p", zeros=False).count() == 1_100
