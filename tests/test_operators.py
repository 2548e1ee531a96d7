"""Steps, encoders, merges and profiles on small tables with awkward cells."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabloom.functions.columns import DuplicateColumn, MissingColumn
from tabloom.operators import encode, explore, merge, prepare, profile, project


def values(df, column):
    return [r[column] for r in df.collect()]


@pytest.fixture(scope="module")
def people(spark):
    # empty cells as in a table a user would upload
    return spark.createDataFrame(
        [(1, 34, "Ann", 1000.0, "IT"), (2, 45, None, 2000.0, "HR"), (3, None, "Cy", None, "IT"), (4, 45, "Di", 4000.0, None)],
        "id bigint, age bigint, name string, salary double, `dept.name` string",
    )


def test_rename_guards(people):
    assert project.rename_column(people, "age", "years").columns[1] == "years"
    with pytest.raises(MissingColumn):
        project.rename_column(people, "gone", "x")
    with pytest.raises(DuplicateColumn):
        project.rename_column(people, "age", "name")


def test_delete_reorder_duplicate_guards(people):
    with pytest.raises(MissingColumn):
        project.delete_columns(people, ["age", "gone"])
    with pytest.raises(MissingColumn):
        project.reorder_columns(people, ["gone"])
    with pytest.raises(DuplicateColumn):
        project.reorder_columns(people, ["id", "id"])
    twice = project.duplicate_column(project.duplicate_column(people, "age"), "age")
    assert twice.columns.count("age_duplicate") == 1


def test_dotted_names(people):
    assert values(project.reorder_columns(people, ["dept.name"]), "dept.name") == ["IT", "HR", "IT", None]
    filled = prepare.fill_value(people, "dept.name", "none")
    assert values(filled, "dept.name")[-1] == "none" and filled.columns == people.columns


def test_filters(people):
    assert values(project.filter_rows(people, "age >= 45"), "id") == [2, 4]
    assert values(project.equality_filters(people, {"age": 45, "salary": None, "name": "Di"}), "id") == [4]
    zero = people.withColumn("flag", F.col("id") > 2)
    assert values(project.equality_filters(zero, {"flag": False}), "id") == [1, 2]
    with pytest.raises(MissingColumn):
        project.equality_filters(people, {"gone": 1})


def test_replace_keeps_null_and_type(people):
    out = project.replace_values(people, "age", "45", "50")
    assert values(out, "age") == [34, 50, None, 50] and out.schema["age"] == people.schema["age"]


def test_head(people):
    assert values(project.head(people, 2, [F.desc("id")]), "id") == [4, 3]
    assert project.head(people, None).count() == 4


def test_has_missing(people, spark):
    assert project.has_missing(people, "id", "age").first()[0] is True
    assert project.has_missing(people, "id", "id").first()[0] is False
    assert project.has_missing(people.limit(0), "id", "age").first()[0] is False


def test_fills(people):
    assert values(prepare.impute(people, ["age"], "Mean"), "age") == [34.0, 45.0, pytest.approx(124 / 3), 45.0]
    assert values(prepare.impute(people, ["age", "salary"], "Median"), "salary") == [1000.0, 2000.0, 2000.0, 4000.0]
    modes = prepare.impute(people, ["age", "name"], "Mode")
    assert values(modes, "age") == [34, 45, 45, 45] and values(modes, "name") == ["Ann", "Ann", "Cy", "Di"]
    assert modes.schema["age"].dataType == people.schema["age"].dataType
    with pytest.raises(ValueError):
        prepare.impute(people, ["age"], "Guess")
    with pytest.raises(TypeError):
        prepare.impute(people, ["name"], "Mean")
    with pytest.raises(Exception):
        prepare.fill_value(people, "age", "many").collect()


def test_scale_edges(spark):
    df = spark.createDataFrame([(0.1, 1, None), (0.1, 3, None), (0.1, None, None)], "c double, x int, e double")
    standard = prepare.scale(df, ["c", "x", "e"], "StandardScaler")
    assert values(standard, "c") == [0.0] * 3 and values(standard, "x") == [-1.0, 1.0, None]
    assert values(standard, "e") == [None] * 3
    bounded = prepare.scale(df, ["c", "x"], "MinMaxScaler")
    assert values(bounded, "c") == [0.0] * 3 and values(bounded, "x") == [0.0, 1.0, None]


def test_minmax_stays_in_unit_interval(spark):
    df = spark.range(500).select((F.sin("id") * 1e6).alias("x"))
    scaled = values(prepare.scale(df, ["x"], "MinMaxScaler"), "x")
    assert min(scaled) == 0.0 and max(scaled) == 1.0


def test_outlier_edges(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, 4.0, 100.0, None, float("nan")]], "x double")
    assert values(prepare.remove_outliers(df, "x", prepare.IQR), "x") == [1.0, 2.0, 3.0, 4.0]
    constant = spark.createDataFrame([(0.1,)] * 5, "x double")
    assert prepare.remove_outliers(constant, "x", prepare.IQR).count() == 5
    assert prepare.remove_outliers(constant, "x", prepare.Z_SCORE).count() == 0
    assert prepare.remove_outliers(df.limit(0), "x", prepare.IQR).count() == 0
    low = spark.createDataFrame([(0.0,)] * 99 + [(-1000.0,)], "x double")
    assert prepare.remove_outliers(low, "x", prepare.Z_SCORE).count() == 99
    assert prepare.remove_outliers(low, "x", prepare.Z_SCORE, ddof=1, one_sided=True).count() == 100


def test_one_hot(people):
    out = encode.one_hot(people, ["dept.name"])
    assert out.columns == ["id", "age", "name", "salary", "dept.name_IT"]
    assert values(out, "dept.name_IT") == [1.0, 0.0, 1.0, 0.0]
    with pytest.raises(encode.TooManyCategories):
        encode.one_hot(people, ["id"], max_categories=3)


def test_label_codes_are_dense_and_sorted(spark):
    words = ["x" * 80 + f"w{(i * 7919) % 3001:05d}" for i in range(5_000)] + ["hot"] * 2_500 + [None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id bigint, w string").repartition(6)
    codes = {w: c for c, w in enumerate(sorted({w for w in words if w}))}
    out = {r["id"]: r["w"] for r in encode.label_encode(df, ["w"]).collect()}
    assert out == {i: codes.get(w) for i, w in enumerate(words)}


def expected_join(left, right, how):
    out, used = [], set()
    for k, a in left:
        hits = [(j, b) for j, (k2, b) in enumerate(right) if k is not None and k2 == k]
        used |= {j for j, _ in hits}
        out += [(k, a, b) for _, b in hits]
        if not hits and how in ("left", "outer"):
            out.append((k, a, None))
    if how in ("right", "outer"):
        out += [(k, None, b) for j, (k, b) in enumerate(right) if j not in used]
    return sorted(out, key=str)


LEFT = [(1, i) for i in range(40)] + [(2, 100), (3, 101), (None, 102), (None, 103), (5, 104), (9, 105)]
RIGHT = [(2, i) for i in range(200, 230)] + [(1, 300), (4, 301), (None, 302), (9, 303), (9, 304)]


@pytest.mark.parametrize("how", merge.JOIN_TYPES)
@pytest.mark.parametrize(
    "hot", [None, {}, {"left": [1]}, {"right": [2]}, {"left": [1, 9, 77], "right": [2, 9, 4]}, {"left": [5], "right": [4]},
     {"left": [None, 1]}, {"left": [None], "right": [None, 2]}]
)
def test_merge_with_hot_keys_is_an_ordinary_join(spark, how, hot):
    left = spark.createDataFrame(LEFT, "k bigint, a bigint")
    right = spark.createDataFrame(RIGHT, "k bigint, b bigint")
    out = merge.merge(left, right, "k", how, hot_keys=hot, salts=4)
    assert out.columns == ["k", "a", "b"]
    assert sorted([tuple(r) for r in out.collect()], key=str) == expected_join(LEFT, RIGHT, how)


def hot_rows(keys, key="k"):
    """The hot keys' hashes and buckets, by side."""
    return {side: {tuple(r) for r in table.collect()} for side, table in (("left", keys.left), ("right", keys.right)) if table is not None}


def hash_of(spark, value, kind="bigint"):
    return spark.range(1).select(F.xxhash64(F.lit(value).cast(kind))).first()[0]


def test_find_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(merge, "BUCKET_ROWS", 12)
    left = spark.createDataFrame(LEFT, "k bigint, a bigint").repartition(3)
    right = spark.createDataFrame(RIGHT, "k bigint, b bigint")
    assert hot_rows(merge.find_hot_keys(left, right, "k")) == {"left": {(hash_of(spark, 1), 4)}, "right": {(hash_of(spark, 2), 3)}}
    for how in merge.JOIN_TYPES:
        out = merge.merge(left, right, "k", how)
        assert sorted([tuple(r) for r in out.collect()], key=str) == expected_join(LEFT, RIGHT, how)


def test_many_hot_keys_are_all_found(spark):
    """1,001 hot keys among 100,000 others."""
    left = spark.range(1001 * 40).selectExpr("id % 1001 AS k").unionAll(spark.range(100_000).selectExpr("id + 5000 AS k"))
    right = spark.createDataFrame([(1,)], "k bigint")
    assert merge.find_hot_keys(left, right, "k", bucket_rows=39).left.count() == 1001


@pytest.mark.parametrize("how", merge.JOIN_TYPES)
def test_hot_keys_of_other_rows_change_nothing(spark, how):
    """A table learnt elsewhere names keys that one side or both sides lack here."""
    left = spark.createDataFrame(LEFT, "k bigint, a bigint")
    right = spark.createDataFrame(RIGHT, "k bigint, b bigint")
    elsewhere = spark.createDataFrame([(k,) for k in (1, 3, 4, 77, None) for _ in range(9)], "k bigint")
    keys = merge.find_hot_keys(elsewhere, elsewhere, "k", bucket_rows=4)
    assert len(hot_rows(keys)["left"]) == len(hot_rows(keys)["right"]) == 5
    out = merge.merge(left, right, "k", how, hot_keys=keys)
    assert sorted([tuple(r) for r in out.collect()], key=str) == expected_join(LEFT, RIGHT, how)


@pytest.mark.parametrize("how", merge.JOIN_TYPES)
def test_equal_rows_of_a_hot_key_are_dealt_over_all_buckets(spark, how):
    left = spark.createDataFrame([(1, "same", {"a": 1}, [{"b": 2}])] * 1000 + [(2, None, None, None)] * 3, "k int, a string, m map<string,int>, n array<map<string,int>>")
    right = spark.createDataFrame([(1, "x"), (3, "y")] + [(None, "z")] * 50, "k bigint, b string")
    keys = merge.find_hot_keys(left, right, "k", bucket_rows=25)
    dealt = merge._dealt(left, "k", keys, keys.left, "bucket")
    assert {r["bucket"]: r["bucket_n"] for r in dealt.filter("k = 1").collect()} == dict.fromkeys(range(40), 25)
    out = Counter(tuple(r)[:2] + (r["m"] and r["m"]["a"], r["n"] and r["n"][0]["b"], r["b"]) for r in merge.merge(left, right, "k", how, hot_keys=keys).collect())
    want = Counter({(1, "same", 1, 2, "x"): 1000})
    want += Counter({(2, None, None, None, None): 3} if how in ("left", "outer") else {})
    want += Counter({(3, None, None, None, "y"): 1, (None, None, None, None, "z"): 50} if how in ("right", "outer") else {})
    assert out == want


def test_outer_merge_of_keys_of_two_widths(spark, monkeypatch):
    monkeypatch.setattr(merge, "BUCKET_ROWS", 30)
    left = spark.createDataFrame([(1, 1)] * 40, "k int, a bigint")
    right = spark.createDataFrame([(1 << 40, i) for i in range(40)] + [(1, 5)], "k bigint, b bigint")
    out = merge.merge(left, right, "k", "outer")
    assert out.groupBy("k").count().orderBy("k").collect() == [(1, 40), (1 << 40, 40)]


def test_merge_sample_pair(spark):
    """Keys 1-5 against 1, 2, 3, 6, 7: 3, 5, 5 and 7 rows."""
    customers = spark.createDataFrame([(i, f"n{i}") for i in range(1, 6)], "CustomerID bigint, Name string")
    orders = spark.createDataFrame([(100 + i, k) for i, k in enumerate((1, 2, 3, 6, 7))], "OrderID bigint, CustomerID bigint")
    counts = {how: merge.merge(customers, orders, "CustomerID", how).count() for how in merge.JOIN_TYPES}
    assert counts == {"inner": 3, "left": 5, "right": 5, "outer": 7}


def test_merge_guards(spark):
    a = spark.createDataFrame([(1, 2)], "k bigint, x int")
    with pytest.raises(MissingColumn):
        merge.merge(a, a.drop("k"), "k")
    with pytest.raises(ValueError):
        merge.merge(a, a, "k", "cross")
    with pytest.raises(TypeError):
        merge.merge(a, a.withColumn("k", F.col("k").cast("string")), "k")
    assert merge.merge(a, a, "k").columns == ["k", "x", "x_right"]
    with pytest.raises(DuplicateColumn):
        merge.merge(a.withColumn("x_right", F.lit(1)), a, "k")


def test_no_shared_columns(spark):
    assert merge.join_key_candidates(spark.range(1), spark.range(1).toDF("other")).count() == 0


def test_duplicate_rows(spark):
    df = spark.createDataFrame([(1, [1.0])] * 3 + [(2, [1.0])] * 2 + [(None, None)] * 2 + [(4, [2.0])], "x int, a array<double>")
    assert tuple(profile.duplicate_rows(df).first()) == (3, 4)
    assert tuple(profile.duplicate_rows(df.limit(0)).first()) == (0, 0)


def test_summary_does_not_depend_on_partitions(spark):
    df = spark.range(2_000).select((F.col("id") % 37).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") / 3).alias("b"))
    once = sorted(profile.column_summary(df.coalesce(1), ["a", "b"]).collect())
    again = sorted(profile.column_summary(df.repartition(9, "b"), ["a", "b"]).collect())
    for x, y in zip(once, again):
        assert x["column_name"] == y["column_name"] and x["unique_values"] == y["unique_values"]
        assert x["std"] == pytest.approx(y["std"]) and x["median"] == y["median"] and x["mode"] == y["mode"]


def test_summary_of_empty_table(spark):
    empty = spark.createDataFrame([], "x double, t string")
    rows = {r["column_name"]: r for r in profile.column_summary(empty, ["x", "t"]).collect()}
    assert rows["x"]["unique_values"] == 0 and rows["x"]["mean"] is None and rows["t"]["missing_values"] == 0
    summary = {r["metric"]: r["value"] for r in profile.dataset_summary(empty).collect()}
    assert summary == {"rows": 0.0, "columns": 2.0, "missing_values": 0.0, "size_mb": 0.0, "duplicate_rows": 0.0}
    assert profile.describe(empty).filter("statistic = 'count' AND value = 0").count() == 2


def test_overview(people):
    parts = profile.overview(people.drop("dept.name"), rows=2)
    assert parts["head"].count() == 2
    assert {r["metric"]: r["value"] for r in parts["summary"].collect()}["missing_values"] == 3.0
    means = {r["column_name"]: r["value"] for r in parts["statistics"].filter("statistic = 'mean'").collect()}
    assert means == {"id": 2.5, "age": pytest.approx(124 / 3), "salary": pytest.approx(7000 / 3)}


def test_filter_options_limit_is_exact(spark):
    df = spark.range(400).select(
        (F.col("id") % 99).alias("n99"),
        (F.col("id") % 100).alias("n100"),
        F.when(F.col("id") % 100 > 0, F.col("id") % 100).alias("null_counts"),
        F.array("id").alias("lists"),
    )
    found = profile.filter_options(df)
    assert {r[0]: r[1] for r in found.groupBy("column_name").count().collect()} == {"n99": 99}
    # a column that looks narrow for long
    late = spark.range(400).select(F.when(F.col("id") < 300, F.lit(0)).otherwise(F.col("id")).alias("late"))
    assert profile.filter_options(late.coalesce(1)).count() == 0


def test_filter_options_of_all_types_over_many_tasks(spark):
    """Each task sees few values, all tasks together too many."""
    df = spark.range(4000).repartition(40, "id").select(
        (F.col("id") % 7).cast("decimal(9,2)").alias("a b"), F.date_add(F.lit("2024-01-30").cast("date"), (F.col("id") % 3).cast("int")).alias("day"),
        F.when(F.col("id") % 2 == 0, F.lit(0.5)).otherwise(F.lit(float("nan"))).alias("f"), F.when(F.col("id") % 3 > 0, F.map_from_arrays(F.array(F.lit("k")), F.array(F.col("id") % 2))).alias("m"),
        (F.col("id") % 150).alias("over"), F.lit(None).cast("string").alias("none"), F.lit("").alias("empty"),
    )
    found: dict = {}
    for r in profile.filter_options(df).collect():
        found.setdefault(r["column_name"], set()).add(r["value"])
    assert found == {
        "a b": {f"{i}.00" for i in range(7)}, "day": {"2024-01-30", "2024-01-31", "2024-02-01"}, "f": {"0.5", "NaN"},
        "m": {None, '{"m":{"k":0}}', '{"m":{"k":1}}'}, "none": {None}, "empty": {""},
    }
    assert profile.filter_options(df.limit(0)).count() == 0


def test_histogram_edges(spark):
    constant = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    assert [tuple(r) for r in explore.histogram(constant, "x").collect()] == [(0, 2.0, 2.0, 2)]
    assert explore.histogram(constant.filter("x > 5"), "x").count() == 0
    spread = spark.range(0, 31).select(F.col("id").cast("double").alias("x"))
    counts = [r["count"] for r in explore.histogram(spread, "x").orderBy("bin").collect()]
    assert counts == [1] * 29 + [2]
    gap = spark.createDataFrame([(0.0,), (30.0,)], "x double")
    assert [r["count"] for r in explore.histogram(gap, "x").orderBy("bin").collect()] == [1] + [0] * 28 + [1]


def test_density_sums_to_one(spark):
    df = spark.range(1_000).select((F.col("id") * F.col("id")).cast("double").alias("x"))
    rows = explore.density(df, "x").collect()
    assert sum(r["density"] * (r["upper"] - r["lower"]) for r in rows) == pytest.approx(1.0)


def test_correlation_ignores_nan_and_null(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (float("nan"), 1.0), (9.0, None)], "x double, y double"
    )
    assert explore.correlation_pair(df, "x", "y").first()[0] == pytest.approx(1.0)
    matrix = {(r["col_a"], r["col_b"]): r["corr"] for r in explore.correlation_matrix(df, ["x", "y"]).collect()}
    assert set(matrix) == set(itertools.product("xy", repeat=2)) and matrix["x", "y"] == pytest.approx(1.0)
    assert explore.correlation_numeric(df.select(F.lit("t").alias("t"))).count() == 0


def test_correlation_over_complete_pairs(spark):
    df = spark.range(200).select(
        (F.sin("id") + 1e6).alias("a"),
        F.when(F.col("id") % 3 > 0, F.cos("id") + F.sin("id")).alias("b"),
        F.when(F.col("id") % 5 > 0, F.col("id") * F.col("id")).alias("c"),
        F.lit(0.1).alias("constant"),
        F.when(F.col("id") < 0, 1.0).alias("empty"),
    )
    frame = df.toPandas().corr()
    found = {(r["col_a"], r["col_b"]): r["corr"] for r in explore.correlation_numeric(df).collect()}
    assert len(found) == 25
    for (a, b), corr in found.items():
        if {"constant", "empty"} & {a, b}:
            assert corr is None
        else:
            assert corr == pytest.approx(frame.loc[a, b], abs=1e-9)
    assert explore.correlation_pair(df, "a", "constant").first()[0] is None


def test_an_infinite_value_spoils_only_the_pairs_that_meet_it(spark):
    rows = [(float(i), float(i * i), float("inf") if i == 3 else float(-i), None if i == 3 else float(i % 4)) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    frame = df.toPandas()
    found = {(r["col_a"], r["col_b"]): r["corr"] for r in explore.correlation_numeric(df).collect()}
    for (a, b), corr in found.items():
        if "c" in (a, b) and "d" not in (a, b):
            assert math.isnan(corr)
        else:
            rows_of_both = frame[frame[[a, b]].notna().all(axis=1)]
            assert corr == pytest.approx(1.0 if a == b else rows_of_both[[a, b]].corr().loc[a, b])


@pytest.mark.parametrize("width", [3, 40])
def test_correlation_of_any_width_takes_two_scans(spark, width):
    df = spark.range(5000).select(*[F.when((F.col("id") + i) % (i + 2) > 0, F.sin(F.col("id") * (i + 1))).alias(f"c{i}") for i in range(width)])
    frame = df.toPandas().corr()
    assert all(r["corr"] == pytest.approx(frame.loc[r["col_a"], r["col_b"]], abs=1e-9) for r in explore.correlation_numeric(df).collect())


def test_bivariate_types(people, spark):
    assert set(explore.bivariate(people, "age", "salary")) == {"points", "correlation"}
    assert set(explore.bivariate(people, "age", "name")) == {"bars"}
    with pytest.raises(TypeError):
        explore.bivariate(people, "name", "dept.name")
    with pytest.raises(TypeError):
        explore.scatter_points(people, ["name"])


def test_box_of_nothing(spark):
    row = explore.box_stats(spark.createDataFrame([(None,)], "x double"), "x").first()
    assert row["q1"] is None and row["outliers"] == 0


def test_cross_tab_wide_fills_zero(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "l string, r string")
    rows = {r["l"]: (r["x"], r["y"]) for r in explore.cross_tab_wide(df, "l", "r", ["x", "y"]).collect()}
    assert rows == {"a": (2, 0), "b": (0, 1)}
    assert not math.isnan(rows["a"][0])
