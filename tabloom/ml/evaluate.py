"""Scores of predictions, as aggregates over the scored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.columns import col, require_columns
from tabloom.operators.encode import sorted_categories


def _scored(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    require_columns(df, [actual, predicted])
    return df.select(col(actual).alias("y"), col(predicted).alias("p")).filter("y IS NOT NULL AND p IS NOT NULL")


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: ``n``, ``mse``, ``rmse``, ``mae``, ``r2``."""
    error = F.col("y") - F.col("p")
    sums = _scored(df, actual, predicted).agg(
        F.count("y").alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop("y").alias("variance"),
    )
    # a constant target is explained fully or not at all
    r2 = F.when(F.col("variance") > 0, 1 - F.col("mse") / F.col("variance")).when(
        F.col("n") > 0, (F.col("mse") == 0).cast("double")
    )
    return sums.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return _scored(df, actual, predicted).agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"))


def _pairs(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return _scored(df, actual, predicted).groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, zeros: bool = True) -> DataFrame:
    """``(actual, predicted, count)`` for every pair of the classes that occur.

    The grid is the square of the classes, made by the tasks that hold them;
    ``zeros=False`` gives only the pairs that rows show.
    """
    pairs = _pairs(df, actual, predicted)
    if not zeros:
        return pairs.select(F.col("y").alias("actual"), F.col("p").alias("predicted"), F.col("n").alias("count"))
    both = pairs.select(F.explode(F.array("y", "p")).alias("label"))
    label_type = both.schema["label"].dataType
    labels = F.array(*[F.lit(c) for c in sorted_categories(both, "label")]).cast(T.ArrayType(label_type))
    zeros = both.distinct().select(F.col("label").alias("y"), F.explode(labels).alias("p"), F.lit(0).cast("bigint").alias("n"))
    return (
        pairs.unionByName(zeros)
        .groupBy(F.col("y").alias("actual"), F.col("p").alias("predicted"))
        .agg(F.sum("n").alias("count"))
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``(label, precision, recall, f1, support)`` per class, then accuracy, macro and
    weighted averages; a ratio without rows counts as zero."""
    n, hit = F.col("n"), F.col("y") == F.col("p")
    sides = F.array(
        F.struct(F.col("y").cast("string").alias("label"), n.alias("support"), F.lit(0).cast("bigint").alias("claimed")),
        F.struct(F.col("p").cast("string").alias("label"), F.lit(0).cast("bigint").alias("support"), n.alias("claimed")),
    )
    per_class = (
        _pairs(df, actual, predicted)
        .select(F.explode(sides).alias("s"), F.when(hit, n).otherwise(0).alias("hits"))
        .groupBy("s.label")
        .agg(F.sum("s.support").alias("support"), F.sum("s.claimed").alias("claimed"), (F.sum("hits") / 2).alias("hits"))
        .select(
            "label",
            _ratio(F.col("hits"), F.col("claimed")).alias("precision"),
            _ratio(F.col("hits"), F.col("support")).alias("recall"),
            _ratio(2 * F.col("hits"), F.col("claimed") + F.col("support")).alias("f1"),
            "support",
            "hits",
        )
    )
    total = F.sum("support")
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / total).alias(c)
    share = F.sum("hits") / total
    averages = per_class.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("label"),
                share.alias("precision"),
                share.alias("recall"),
                share.alias("f1"),
                total.alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("label"),
                F.avg("precision").alias("precision"),
                F.avg("recall").alias("recall"),
                F.avg("f1").alias("f1"),
                total.alias("support"),
            ),
            F.struct(F.lit("weighted avg").alias("label"), *[weighted(c) for c in ("precision", "recall", "f1")], total.alias("support")),
        ).alias("rows"),
        total.alias("total"),
    ).filter("total > 0").select(F.inline("rows"))
    return per_class.drop("hits").unionByName(averages)
