"""Training several model families and comparing them on a leaderboard."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.ml import evaluate
from tabloom.ml.features import CLASSIFICATION, REGRESSION, feature_names, feature_pipeline, label_stage
from tabloom.ml.split import fold, split

# Families by task, the most models trained, the seed
FAMILIES = {
    CLASSIFICATION: ("GBM", "DRF", "GLM", "DeepLearning", "NaiveBayes", "StackedEnsemble"),
    REGRESSION: ("GBM", "DRF", "GLM", "StackedEnsemble"),
}
MAX_MODELS = 20
SEED = 1

STACKED = "StackedEnsemble"
SORT_METRIC = {CLASSIFICATION: "logloss", REGRESSION: "rmse"}


@dataclass(frozen=True)
class Candidate:
    model_id: str
    family: str
    estimator: Estimator


@dataclass
class Trained:
    """A model that scores raw tables, and what it was built from."""

    model_id: str
    family: str
    task: str
    pipeline: PipelineModel
    model: Model
    metrics: dict[str, float | None] = field(default_factory=dict)


@dataclass
class TrainingRun:
    task: str
    target: str
    models: list[Trained]
    test: DataFrame
    names: list[str]
    deviations: list[float]

    def leaderboard(self, spark: SparkSession) -> DataFrame:
        """One row per model, the best on the validation part first."""
        metric = SORT_METRIC[self.task]
        names = list(self.models[0].metrics)
        rows = [(m.model_id, m.family, *[m.metrics[n] for n in names]) for m in self.models]
        schema = "model_id string, family string, " + ", ".join(f"{n} double" for n in names)
        return spark.createDataFrame(rows, schema).orderBy(F.asc_nulls_last(metric), "model_id")

    def model(self, model_id: str) -> Trained:
        return next(m for m in self.models if m.model_id == model_id)

    def best(self) -> Trained:
        metric = SORT_METRIC[self.task]
        return min(self.models, key=lambda m: (m.metrics[metric] is None, m.metrics[metric], m.model_id))


def candidates(task: str, families: list[str], classes: int, features: int) -> list[Candidate]:
    """A small grid per family, the variants of each family in turn."""
    per_family: dict[str, list[Estimator]] = {}
    if task == CLASSIFICATION:
        boosted = [GBTClassifier(maxIter=20, maxDepth=d, stepSize=0.1, seed=SEED) for d in (3, 5)]
        per_family["GBM"] = boosted if classes <= 2 else [OneVsRest(classifier=g) for g in boosted]
        per_family["DRF"] = [RandomForestClassifier(numTrees=t, maxDepth=d, seed=SEED) for t, d in ((50, 5), (50, 10))]
        per_family["GLM"] = [LogisticRegression(regParam=r, maxIter=50) for r in (0.0, 0.01, 0.1)]
        per_family["NaiveBayes"] = [NaiveBayes(modelType="gaussian")]
        per_family["DeepLearning"] = [
            MultilayerPerceptronClassifier(layers=[features, h, classes], maxIter=100, seed=SEED) for h in (8, 16)
        ]
    else:
        per_family["GBM"] = [GBTRegressor(maxIter=20, maxDepth=d, stepSize=0.1, seed=SEED) for d in (3, 5)]
        per_family["DRF"] = [RandomForestRegressor(numTrees=t, maxDepth=d, seed=SEED) for t, d in ((50, 5), (50, 10))]
        per_family["GLM"] = [
            *[LinearRegression(regParam=r, maxIter=50) for r in (0.0, 0.1)],
            GeneralizedLinearRegression(family="gaussian", regParam=1.0, maxIter=25),
        ]
    unknown = [f for f in families if f not in per_family and f != STACKED]
    if unknown:
        raise ValueError(f"no model family {unknown} for {task}; choose from {sorted(FAMILIES[task])}")
    found = []
    for variant in range(max(len(v) for v in per_family.values())):
        for family in families:
            if family != STACKED and variant < len(per_family[family]):
                found.append(Candidate(f"{family}_{variant + 1}", family, per_family[family][variant]))
    return found


def _together(jobs: list, parallelism: int) -> list:
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(lambda job: inheritable_thread_target(SparkSession.active())(job)(), jobs))


def train(
    df: DataFrame,
    target: str,
    task: str,
    key: str,
    families: list[str] | None = None,
    max_models: int = MAX_MODELS,
    parallelism: int = 4,
    folds: int = 3,
    hashed: tuple[str, ...] = (),
) -> TrainingRun:
    """Fit up to ``max_models`` models on the train part, score them on the validation part.

    ``key`` identifies a row; it decides the split and is not a feature. Rows
    without a target are left out; text columns in ``hashed`` are hashed, not one-hot encoded.
    """
    if task not in FAMILIES:
        raise ValueError(f"unknown task '{task}'; choose one of {sorted(FAMILIES)}")
    families = families or list(FAMILIES[task])
    labelled = df.filter(F.col(f"`{target}`").isNotNull())
    parts = split(labelled, key, SEED)
    prepared = feature_pipeline(parts["train"], target, leave_out=(key,), hashed=hashed).fit(parts["train"])
    labeller = Pipeline(stages=[label_stage(target, task)]).fit(parts["train"])
    labels = list(labeller.stages[0].labels) if task == CLASSIFICATION else []
    # rows of a class that training never saw are misses of every model, so they are judged as well
    judging = labeller
    if task == CLASSIFICATION:
        judging = PipelineModel([labeller.stages[0].copy().setHandleInvalid("keep")])
    fit_on, judge_on = (
        by.transform(prepared.transform(parts[part]))
        .select(F.col(f"`{key}`"), "features", "label")
        .persist(StorageLevel.MEMORY_AND_DISK)
        for part, by in (("train", labeller), ("validation", judging))
    )
    try:
        names = feature_names(fit_on)
        spread = fit_on.agg(Summarizer.std(F.col("features")).alias("s")).first()["s"]
        deviations = spread.toArray().tolist() if spread is not None else []

        stacked = STACKED in families
        chosen = candidates(task, families, max(len(labels), 2), len(deviations))
        if stacked and not chosen:
            chosen = candidates(task, [f for f in FAMILIES[task] if f != STACKED], max(len(labels), 2), len(deviations))
        chosen = chosen[: max(1, max_models - int(stacked))]
        models = _together([lambda c=c: c.estimator.fit(fit_on) for c in chosen], parallelism)
        trained = [_trained(c.model_id, c.family, task, prepared, [m], m, labels) for c, m in zip(chosen, models)]
        if stacked:
            trained.append(_stack(task, prepared, chosen, models, fit_on, labels, key, folds, parallelism))
        for t in trained:
            t.metrics = _judge(t, judge_on, task, prepared, len(labels))
    finally:
        fit_on.unpersist()
        judge_on.unpersist()
    return TrainingRun(task, target, trained, parts["test"], names, deviations)


def _trained(
    model_id: str, family: str, task: str, prepared: PipelineModel, tail: list, model: Model, labels: list[str]
) -> Trained:
    if task == CLASSIFICATION:
        last = IndexToString(inputCol="prediction", outputCol="predict", labels=labels)
    else:
        last = SQLTransformer(statement="SELECT *, prediction AS predict FROM __THIS__")
    return Trained(model_id, family, task, PipelineModel([*prepared.stages, *tail, last]), model)


def _judge(t: Trained, featured: DataFrame, task: str, prepared: PipelineModel, classes: int) -> dict[str, float | None]:
    for stage in t.pipeline.stages[len(prepared.stages) : -1]:
        featured = stage.transform(featured)
    scored = featured
    if task == REGRESSION:
        row = evaluate.regression_metrics(scored, "label", "prediction").first()
        return {m: row[m] for m in ("rmse", "mse", "mae", "r2")}
    row = (
        scored.groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("prediction")).alias("hits"))
        .agg(
            (F.sum("hits") / F.sum("n")).alias("accuracy"),
            F.avg(1 - F.col("hits") / F.col("n")).alias("mean_per_class_error"),
        )
        .first()
    )
    metrics: dict[str, float | None] = {"logloss": None, "auc": None, **row.asDict()}
    known = scored.filter(F.col("label") < classes)  # a class without a probability has no loss
    if "probability" in scored.columns:
        metrics["logloss"] = MulticlassClassificationEvaluator(metricName="logLoss").evaluate(known)
    if classes == 2 and "rawPrediction" in scored.columns:
        metrics["auc"] = BinaryClassificationEvaluator().evaluate(known)
    return metrics


# -- stacking -----------------------------------------------------------------

def _outputs(estimator: Estimator | Model, number: int) -> list[str]:
    """Give the columns a base model adds names of their own; return the meta features."""
    features = f"base_{number}"
    if estimator.hasParam("probabilityCol"):
        estimator.set(estimator.getParam("probabilityCol"), features)
        estimator.set(estimator.getParam("rawPredictionCol"), f"raw_{number}")
    elif estimator.hasParam("rawPredictionCol"):
        estimator.set(estimator.getParam("rawPredictionCol"), features)
    else:
        estimator.set(estimator.getParam("predictionCol"), features)
        return [features]
    estimator.set(estimator.getParam("predictionCol"), f"vote_{number}")
    return [features]


def _stack(
    task: str,
    prepared: PipelineModel,
    chosen: list[Candidate],
    models: list[Model],
    fit_on: DataFrame,
    labels: list[str],
    key: str,
    folds: int,
    parallelism: int,
) -> Trained:
    """A meta model over out-of-fold outputs of the first variant of each family.

    Every row belongs to one fold, so its base outputs are appended by the
    models trained without that fold and the folds are put together again by a
    union; nothing is joined.
    """
    base = {c.family: i for i, c in reversed(list(enumerate(chosen)))}
    picked = sorted(base.values())
    folded = fit_on.withColumn("fold", fold(key, folds, SEED))
    estimators = [chosen[i].estimator.copy() for i in picked]
    meta_inputs = [name for n, e in enumerate(estimators) for name in _outputs(e, n)]
    jobs = [
        lambda e=e, f=f: e.fit(folded.filter(F.col("fold") != f)) for f in range(folds) for e in estimators
    ]
    fitted = _together(jobs, parallelism)
    levels = []
    for f in range(folds):
        part = folded.filter(F.col("fold") == f)
        for model in fitted[f * len(estimators) : (f + 1) * len(estimators)]:
            part = model.transform(part)
        levels.append(part.select("label", *meta_inputs))
    assembler = VectorAssembler(inputCols=meta_inputs, outputCol="meta_features", handleInvalid="keep")
    if task == CLASSIFICATION:
        meta = LogisticRegression(featuresCol="meta_features", regParam=0.01, maxIter=50)
    else:
        meta = LinearRegression(featuresCol="meta_features", regParam=0.01, maxIter=50)
    meta_model = meta.fit(assembler.transform(reduce(DataFrame.unionByName, levels)))
    finals = []
    for n, i in enumerate(picked):
        final = models[i].copy()
        _outputs(final, n)
        finals.append(final)
    return _trained(f"{STACKED}_1", STACKED, task, prepared, [*finals, assembler, meta_model], meta_model, labels)


# -- using a model ------------------------------------------------------------

def predict(trained: Trained, df: DataFrame) -> DataFrame:
    """The rows of ``df`` with ``predict`` beside them."""
    scored = trained.pipeline.transform(df)
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], "predict")


def feature_importance(run: TrainingRun, trained: Trained, spark: SparkSession) -> DataFrame:
    """``(variable, importance, share)``, largest first; for linear models the size of
    the standardised coefficients. Empty when the model has no notion of it."""
    model = trained.model
    if trained.family == STACKED:
        weights = None
    elif hasattr(model, "featureImportances"):
        weights = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        weights = abs(model.coefficientMatrix.toArray()).max(axis=0) * run.deviations
    elif hasattr(model, "coefficients"):
        weights = abs(model.coefficients.toArray()) * run.deviations
    else:
        weights = None
    schema = "variable string, importance double, share double"
    if weights is None:
        return spark.createDataFrame([], schema)
    total = float(weights.sum()) or 1.0
    rows = [(n, float(w), float(w) / total) for n, w in zip(run.names, weights)]
    return spark.createDataFrame(rows, schema).orderBy(F.desc("importance"), "variable")


def save_model(trained: Trained, path: str) -> str:
    trained.pipeline.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
