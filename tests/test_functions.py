"""Types, casts, exact quantiles, modes and fits."""

from __future__ import annotations

import datetime
import decimal
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import quantiles, stats
from tabloom.functions.columns import MissingColumn
from tabloom.functions.types import TYPES, cast_column
from tabloom.operators.project import change_type


def one(spark, value, kind):
    return spark.createDataFrame([(value,)], f"x {kind}")


def test_signed_casts(spark):
    for name, kind in (("Int8", "tinyint"), ("Int16", "smallint"), ("Int32", "int"), ("Int64", "bigint")):
        out = change_type(one(spark, "7", "string"), "x", name)
        assert out.schema["x"].dataType.simpleString() == kind
        assert out.first()["x"] == 7


@pytest.mark.parametrize("name", [n for n, t in TYPES.items() if t.maximum is not None])
def test_unsigned_range(spark, name):
    top = TYPES[name].maximum
    assert change_type(one(spark, str(top), "string"), "x", name).first()["x"] == top
    assert change_type(one(spark, "0", "string"), "x", name).first()["x"] == 0
    assert change_type(one(spark, None, "string"), "x", name).first()["x"] is None
    for bad in (str(top + 1), "-1"):
        assert change_type(one(spark, bad, "string"), "x", name, lenient=True).first()["x"] is None
        with pytest.raises(Exception):
            change_type(one(spark, bad, "string"), "x", name).collect()


def test_strict_and_lenient_text(spark):
    with pytest.raises(Exception):
        change_type(one(spark, "abc", "string"), "x", "Int64").collect()
    assert change_type(one(spark, "abc", "string"), "x", "Int64", lenient=True).first()["x"] is None


def test_times(spark):
    micros = 1_704_067_200_000_001
    stamp = datetime.datetime(2024, 1, 1, 0, 0, 0, 1)
    as_time = change_type(one(spark, micros, "bigint"), "x", "Datetime")
    assert as_time.first()["x"] == stamp
    assert change_type(as_time, "x", "Int64").first()["x"] == micros
    early = change_type(one(spark, -1_500_000, "bigint"), "x", "Datetime")
    assert change_type(early, "x", "Int64").first()["x"] == -1_500_000
    assert change_type(one(spark, 3, "int"), "x", "Date").first()["x"] == datetime.date(1970, 1, 4)
    span = change_type(one(spark, 90_000_000, "bigint"), "x", "Duration")
    assert span.first()["x"] == datetime.timedelta(seconds=90)
    assert change_type(span, "x", "Int64").first()["x"] == 90_000_000
    assert change_type(one(spark, "12:34:56", "string"), "x", "Time").first()["x"] == datetime.time(12, 34, 56)


def test_list_and_unknown_type(spark):
    assert change_type(one(spark, 5, "int"), "x", "List").first()["x"] == ["5"]
    with pytest.raises(ValueError):
        cast_column(one(spark, 5, "int"), "x", "Object")


VALUES = {
    "uniform": [random.Random(1).random() for _ in range(4_000)],
    "a third in one value": [3.0] * 1_500 + [random.Random(2).gauss(0, 5) for _ in range(3_000)],
    "few values": [float(i % 3) for i in range(3_001)],
    "constant": [2.5] * 500,
    "single": [4.0],
    "two": [1.0, 2.0],
    "long tail": [random.Random(3).paretovariate(0.3) for _ in range(2_000)],
}


@pytest.mark.parametrize("name", list(VALUES))
@pytest.mark.parametrize("small", [1, 50, 20_000])
def test_quantiles_equal_numpy(spark, name, small):
    values = VALUES[name]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    df = df.unionByName(spark.createDataFrame([(None,), (float("nan"),)], "x double"))
    probabilities = [0.0, 0.001, 0.25, 0.5, 0.75, 0.99, 1.0]
    linear = quantiles.exact_quantiles(df, {"x": probabilities}, small=small)
    for q in probabilities:
        assert linear["x", q] == pytest.approx(np.quantile(values, q), rel=1e-12)
    nearest = quantiles.exact_quantiles(df, {"x": probabilities}, "nearest", small=small)
    ordered = sorted(values)
    for q in probabilities:
        assert nearest["x", q] == ordered[int(q * (len(values) - 1) + 0.5)]


def test_quantiles_of_many_columns(spark):
    """More columns than one pass takes, more edges than one aggregate counts."""
    df = spark.range(3_000).select(*[((F.col("id") * (7 * i + 1)) % 2_999).alias(f"c{i}") for i in range(10)])
    wanted = {c: [0.25, 0.5, 0.9] for c in df.columns}
    found = quantiles.exact_quantiles(df, wanted, small=20)
    exact = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9))).alias(c) for c in df.columns]).first()
    for c in df.columns:
        assert [found[c, q] for q in wanted[c]] == pytest.approx(list(exact[c]))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1)], "x double, y int")
    found = quantiles.exact_quantiles(df, {"x": [0.5], "y": [0.5]})
    assert found == {("x", 0.5): None, ("y", 0.5): 1.0}


def test_quantiles_survive_a_coarse_sketch(spark, monkeypatch):
    """Ranks outside the bracket of a bad sketch are still found."""
    monkeypatch.setattr(quantiles, "ACCURACY", 2)
    monkeypatch.setattr(quantiles, "SAMPLED", 10)
    df = spark.createDataFrame([(float(v),) for v in VALUES["uniform"]], "x double").repartition(4)
    found = quantiles.exact_quantiles(df, {"x": [0.1, 0.5, 0.9]}, small=3)
    for q in (0.1, 0.5, 0.9):
        assert found["x", q] == pytest.approx(np.quantile(VALUES["uniform"], q))


def test_modes(spark):
    df = spark.createDataFrame(
        [("b", 1, 1.5, None), ("a", 2, 1.5, None), ("b", 1, None, None), ("a", None, 2.5, None), (None, None, None, None)],
        "t string, i int, d double, n string",
    )
    assert stats.modes(df, df.columns) == {"t": "a", "i": 1, "d": 1.5, "n": None}


def test_mode_of_other_types(spark):
    day = datetime.date(2024, 2, 1)
    df = spark.createDataFrame([(day, True, decimal.Decimal("1.50"))] * 2, "d date, b boolean, m decimal(6,2)")
    assert stats.modes(df, df.columns) == {"d": day, "b": "true", "m": decimal.Decimal("1.50")}


def test_fit_shares_passes_and_checks_columns(spark):
    df = spark.range(1, 6).withColumn("x", F.col("id") * 2.0)
    needs = [("mean", "x"), ("median", "x"), ("mode", "id"), ("quantile", "x", 0.25), ("nearest", "x", 0.3), ("max", "id")]
    assert stats.fit(df, needs) == {
        ("mean", "x"): 6.0, ("median", "x"): 6.0, ("mode", "id"): 1, ("quantile", "x", 0.25): 4.0,
        ("nearest", "x", 0.3): 4.0, ("max", "id"): 5.0,
    }
    with pytest.raises(MissingColumn):
        stats.fit(df, [("mean", "gone")])
