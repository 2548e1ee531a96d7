"""Splits, training and scoring of predictions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.ml import dictionary, evaluate, split, train
from tabloom.ml.features import CLASSIFICATION, REGRESSION, feature_pipeline, label_stage
from tabloom.session import scratch_path
from workload.registry import query, rounded, table

_BUCKET = "CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|1'), 1, 8) AS BIGINT) % 100"


@query(
    "train_test_split",
    f"""SELECT o_orderkey, CASE WHEN {_BUCKET} < 70 THEN 'train' WHEN {_BUCKET} < 85 THEN 'validation' ELSE 'test' END AS part
        FROM orders""",
)
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.with_part(table(spark, sf_dir, "orders"), "o_orderkey", seed=1).select("o_orderkey", "part")


# -- scores of a fixed prediction ---------------------------------------------

@query(
    "regression_metrics",
    """WITH s AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem), m AS (SELECT avg(y) AS c FROM s)
       SELECT count(*) AS n, round(avg((y - p) * (y - p)), 1) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
              round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) * (y - p)) / sum((y - c) * (y - c)), 6) AS r2 FROM s, m""",
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "lineitem").withColumn("predict", F.col("l_quantity") * 1500)
    metrics = evaluate.regression_metrics(scored, "l_extendedprice", "predict")
    return rounded(rounded(rounded(metrics, 1, "mse"), 4, "rmse", "mae"), 6, "r2")


_SCORED = """SELECT o_orderstatus AS y, CASE WHEN o_orderkey % 3 = 0 THEN 'F' WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS p
             FROM orders"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(F.col("o_orderkey") % 3 == 0, "F").when(F.col("o_orderkey") % 7 == 0, "X")
    return table(spark, sf_dir, "orders").withColumn("predict", guess.otherwise(F.col("o_orderstatus")))


@query("accuracy", f"SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 8)::DOUBLE AS accuracy FROM ({_SCORED})")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.accuracy(_scored(spark, sf_dir), "o_orderstatus", "predict"), 8, "accuracy")


@query(
    "confusion_matrix",
    f"""WITH s AS ({_SCORED}), c AS (SELECT y AS l FROM s UNION SELECT p FROM s),
             n AS (SELECT y, p, count(*) AS n FROM s GROUP BY ALL)
        SELECT a.l AS actual, b.l AS predicted, coalesce(n, 0) AS count
        FROM c a CROSS JOIN c b LEFT JOIN n ON n.y = a.l AND n.p = b.l""",
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_matrix(_scored(spark, sf_dir), "o_orderstatus", "predict")


@query(
    "classification_report",
    f"""WITH s AS ({_SCORED}), c AS (SELECT y AS label FROM s UNION SELECT p FROM s),
             t AS (SELECT label, (SELECT count(*) FROM s WHERE y = label) AS support, (SELECT count(*) FROM s WHERE p = label) AS claimed,
                          (SELECT count(*) FROM s WHERE y = label AND p = label) AS hits FROM c),
             r AS (SELECT label, CASE WHEN claimed > 0 THEN hits / claimed ELSE 0 END AS precision,
                          CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall, 2 * hits / (claimed + support) AS f1,
                          support, hits FROM t),
             a AS (SELECT label, precision, recall, f1, support FROM r
                   UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM r
                   UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
                   UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                                    sum(f1 * support) / sum(support), sum(support) FROM r)
        SELECT label, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support::BIGINT AS support FROM a""",
)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = evaluate.classification_report(_scored(spark, sf_dir), "o_orderstatus", "predict")
    return rounded(report, 8, "precision", "recall", "f1")


# -- training -----------------------------------------------------------------

def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(documents, "doc_id")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice"
    )


@query("feature_matrix")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir)
    prepared = feature_pipeline(labelled, "quality", leave_out=("doc_id",)).fit(labelled).transform(labelled)
    labeller = label_stage("quality", CLASSIFICATION).fit(labelled)
    return labeller.transform(prepared).select("doc_id", "label", vector_to_array("features").alias("features"))


_ALL = "SELECT l.doc_id, l.quality, l.toxic, d.text, d.lang, d.source, d.n_chars FROM labels l JOIN documents d USING (doc_id)"


@query(
    "feature_dictionary",
    f"""WITH l AS ({_ALL}),
             v AS (SELECT DISTINCT 0 AS c, text AS v FROM l WHERE text IS NOT NULL UNION ALL SELECT DISTINCT 1, lang FROM l WHERE lang IS NOT NULL
                   UNION ALL SELECT DISTINCT 2, source FROM l WHERE source IS NOT NULL),
             s AS (SELECT c, v, 1 + row_number() OVER (ORDER BY c, v) AS slot FROM v)
        SELECT doc_id, 0 AS slot, toxic::DOUBLE AS value FROM l UNION ALL SELECT doc_id, 1, n_chars FROM l
        UNION ALL SELECT doc_id, slot, 1.0 FROM l JOIN s ON c = 0 AND v = text
        UNION ALL SELECT doc_id, slot, 1.0 FROM l JOIN s ON c = 1 AND v = lang
        UNION ALL SELECT doc_id, slot, 1.0 FROM l JOIN s ON c = 2 AND v = source""",
)
def feature_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse features of all columns, whole texts included, an entry a row."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labelled = table(spark, sf_dir, "labels").join(documents, "doc_id")
    found = dictionary.encode(labelled, dictionary.learn(labelled, "quality", leave_out=("doc_id",)))
    entries = F.arrays_zip(F.col("features.indices").alias("slot"), F.col("features.values").alias("value"))
    return found.select("doc_id", F.inline(entries)).select("doc_id", F.col("slot").cast("bigint").alias("slot"), "value")


def _classify(spark: SparkSession, sf_dir: str, families: list[str], max_models: int) -> train.TrainingRun:
    return train.train(_labelled(spark, sf_dir), "quality", CLASSIFICATION, "doc_id", families, max_models)


def _regress(spark: SparkSession, sf_dir: str, families: list[str], max_models: int) -> train.TrainingRun:
    return train.train(_orders(spark, sf_dir), "o_totalprice", REGRESSION, "o_orderkey", families, max_models)


@query("automl_classification")
def automl_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = ["GBM", "DRF", "GLM", "NaiveBayes", "DeepLearning"]
    return _classify(spark, sf_dir, families, max_models=6).leaderboard(spark)


@query("automl_regression")
def automl_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regress(spark, sf_dir, ["GBM", "DRF", "GLM"], max_models=4).leaderboard(spark)


@query("leaderboard")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaderboard and, as its last row, the maximum of each metric."""
    board = _regress(spark, sf_dir, ["GLM"], max_models=3).leaderboard(spark)
    metrics = [c for c in board.columns if c not in ("model_id", "family")]
    highest = board.agg(*[F.max(m).alias(m) for m in metrics])
    return board.unionByName(highest.withColumns({"model_id": F.lit("maximum"), "family": F.lit("")}))


@query("stacked_ensemble")
def stacked_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _classify(spark, sf_dir, ["DRF", "GLM", train.STACKED], max_models=3)
    return train.predict(run.model("StackedEnsemble_1"), run.test).select("doc_id", "quality", "predict")


@query("predict")
def predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _regress(spark, sf_dir, ["GLM"], max_models=1)
    return train.predict(run.best(), run.test).select("o_orderkey", "o_totalprice", "predict")


@query("feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _regress(spark, sf_dir, ["DRF"], max_models=1)
    return train.feature_importance(run, run.best(), spark)


@query("model_roundtrip")
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _classify(spark, sf_dir, ["GLM"], max_models=1)
    loaded = train.load_model(train.save_model(run.best(), scratch_path(spark, "model")))
    return loaded.transform(run.test).select("doc_id", "quality", "predict")
