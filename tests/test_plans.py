"""Recipes, versions and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tabloom.functions import stats
from tabloom.functions.columns import MissingColumn
from tabloom.plans import recipe, versions
from tabloom.plans.recipe import Library, Step, fit_recipe, replay, replay_version
from tabloom.session import scratch_path
from tabloom.streaming.replay import replay_new_files


def step(kind, **parameters):
    return Step(kind, parameters)


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0, None), (2, "b", None, 4), (3, "a", 3.0, 6), (4, None, 100.0, 8)],
        "id bigint, kind string, price double, amount int",
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


UNFITTED = [
    step("Rename Column", old_name="price", new_name="cost"),
    step("Filter Rows", condition="id > 1"),
    step("Add Calculated Column", new_column="twice", formula="cost * 2"),
    step("Replace Values", column="kind", to_replace="a", replace_with="z"),
    step("Duplicate Column", column="id"),
    step("Fill Missing Values", column="kind", method="Specific Value", value="none"),
]


@pytest.mark.parametrize("cut", range(len(UNFITTED) + 1))
def test_replay_in_parts(sales, cut):
    whole = replay(sales, UNFITTED)
    parts = replay(replay(sales, UNFITTED[:cut]), UNFITTED[cut:])
    assert whole.columns == parts.columns and rows(whole) == rows(parts)


def test_empty_recipe_is_the_table(sales):
    assert rows(replay(sales, [])) == rows(sales)


def test_unknown_operation_fails_before_anything_runs(sales):
    with pytest.raises(ValueError, match="unknown operation"):
        replay(sales, [step("Delete Column", columns=["gone"]), step("Shuffle Rows")])
    with pytest.raises(MissingColumn):
        replay(sales, [step("Delete Column", columns=["gone"])])


def test_every_type_is_known():
    assert len({id(o) for o in recipe.OPERATIONS.values()}) == 14


FITTED = [
    step("Fill Missing Values", column="price", method="Mean"),
    step("Impute Missing Values", columns=["amount"], method="Median"),
    step("Fill Missing Values", column="kind", method="Mode"),
    step("Scale Data", columns=["price"], method="MinMaxScaler"),
    step("Remove Outliers", column="amount", method="IQR Method"),
    step("Scale Data", columns=["amount"], method="StandardScaler"),
]


def test_neighbouring_fits_share_a_pass_and_equal_single_steps(sales, monkeypatch):
    one_by_one = sales
    for s in FITTED:
        one_by_one = replay(one_by_one, [s])
    calls = []
    monkeypatch.setattr(recipe, "fit", lambda df, needs: calls.append(1) or stats.fit(df, needs))
    together = replay(sales, FITTED)
    assert rows(together) == rows(one_by_one)
    # price, amount and kind together; scaling price waits for its fill, outliers
    # for the filled amount (same batch); scaling amount waits for the filter
    assert len(calls) == 3


def test_fitted_recipe_applies_to_new_rows(spark, sales):
    fitted = fit_recipe(sales, [*FITTED[:4], step("Encode Data", columns=["kind"], type="LabelEncoding")])
    fresh = spark.createDataFrame([(9, "b", None, None), (10, "new", 1.0, 2)], sales.schema)
    out = {r["id"]: r for r in fitted.apply(fresh).collect()}
    mean = (1 + 3 + 100) / 3
    assert out[9]["price"] == pytest.approx((mean - 1) / 99) and out[9]["amount"] == 6.0
    assert out[9]["kind"] == 1 and out[10]["kind"] is None


def test_both_names_of_encoding(sales):
    one = replay(sales, [step("Encode Data", columns=["kind"], type="OneHotEncoding")])
    other = replay(sales, [step("Encode Categorical Variables", columns=["kind"], type="OneHotEncoding")])
    assert one.columns == other.columns == ["id", "price", "amount", "kind_b"]
    assert rows(one) == rows(other)


def merge_step(dataset, version):
    return step("Merge Datasets", merge_with=dataset, merge_version=version, join_column="id", join_type="left")


def test_merge_cycles_and_unknown_versions(sales):
    other = sales.select("id", F.lit("x").alias("tag"))
    library = Library(
        datasets={1: sales, 2: lambda: other},
        versions={10: (1, [merge_step(2, 20)]), 20: (2, [merge_step(1, 10)]), 21: (2, [])},
    )
    with pytest.raises(ValueError, match="cycle"):
        replay_version(library, 1, 10)
    with pytest.raises(KeyError):
        replay(sales, [merge_step(2, 99)], library)
    with pytest.raises(KeyError):
        replay(sales, [merge_step(3, 21)], library)
    assert replay(sales, [merge_step(2, 21)], library).columns == [*sales.columns, "tag"]
    # the same version twice in a row is no cycle
    assert replay(sales, [merge_step(2, 21), step("Delete Column", columns=["tag"]), merge_step(2, 21)], library).count() == 4


def test_step_log_round_trip(spark, sales):
    log = versions.logged(UNFITTED, 5, spark, first_id=10).unionByName(versions.logged(FITTED, 6, spark, first_id=100))
    assert versions.load_steps(log, 5) == UNFITTED
    removed = spark.createDataFrame([(11,)], "id bigint")
    without = UNFITTED[:1] + UNFITTED[2:]
    assert versions.load_steps(log, 5, removed) == without
    assert rows(replay(sales, versions.load_steps(log, 5, removed))) == rows(replay(sales, without))


def test_version_from_base(spark):
    log = versions.logged(UNFITTED, 1, spark)
    added = versions.logged(FITTED[:2], 2, spark)
    new = versions.version_from_base(log, 1, 2, added)
    assert versions.load_steps(new, 2) == UNFITTED + FITTED[:2]
    ids = [r["id"] for r in log.unionByName(new).collect()]
    assert len(set(ids)) == len(ids)


def test_materialise(spark, sales):
    base = scratch_path(spark, "versions")
    first = versions.materialise(sales, [], base, "sales")
    assert rows(first) == rows(sales)
    second = versions.materialise(sales, UNFITTED, base, "sales", "v2")
    assert rows(second) == rows(replay(sales, UNFITTED)) and first.count() == 4


def test_parameters_are_json():
    s = Step.from_json("Rename Column", json.dumps({"old_name": "a", "new_name": "b"}))
    assert s == step("Rename Column", old_name="a", new_name="b")


def test_fitted_recipe_on_a_stream(spark, sales):
    source, target, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "state"))
    fitted = fit_recipe(
        sales, [FITTED[0], FITTED[3], step("Encode Data", columns=["kind"], type="LabelEncoding"), UNFITTED[1]]
    )
    for _ in range(2):  # the second run only sees the new file
        sales.write.mode("append").parquet(source)
        replay_new_files(spark, source, sales.schema, fitted, target, checkpoint).awaitTermination(120)
    assert rows(spark.read.parquet(target)) == rows(fitted.apply(sales).unionByName(fitted.apply(sales)))


def test_ids_of_forks_grow_by_one_step(spark):
    log = versions.logged(UNFITTED, 1, spark)
    largest = len(UNFITTED)
    for version in range(2, 102):
        fork = versions.version_from_base(log, version - 1, version)
        steps = [tuple(r) for r in fork.orderBy("id").collect()]
        largest += len(UNFITTED)
        assert steps[-1][0] == largest and len(steps) == len(UNFITTED)
        log = spark.createDataFrame(steps, versions.STEP_SCHEMA)
    assert versions.load_steps(log, 101) == UNFITTED


@pytest.fixture
def counted(spark, sf_dir):
    """The orders, and how often all of them have been read."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        reads.add(1)
        return True

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.filter(seen("o_orderkey")), lambda: reads.value / orders.count()


FITS = [
    step("Remove Outliers", column="o_totalprice", method="IQR Method"), step("Scale Data", columns=["o_totalprice"], method="StandardScaler"),
    step("Encode Data", columns=["o_orderstatus"], type="LabelEncoding"), step("Fill Missing Values", column="balance", method="Mean"),
    step("Scale Data", columns=["balance"], method="MinMaxScaler"), step("Encode Data", columns=["o_orderpriority"], type="OneHotEncoding"),
]


def shop(spark, sf_dir, orders, further=()):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    begin = [
        step("Rename Column", old_name="o_custkey", new_name="c_custkey"),
        step("Merge Datasets", merge_with="c", merge_version="good", join_column="c_custkey", join_type="inner"),
    ]
    good = [step("Filter Rows", condition="c_acctbal > 0"), step("Rename Column", old_name="c_acctbal", new_name="balance"), *further]
    return Library({"o": orders, "c": customer}, {"good": ("c", good)}), begin


@pytest.mark.parametrize("fits", [2, 4, 6])
def test_further_fits_do_not_read_the_source_again(spark, sf_dir, counted, fits):
    orders, reads = counted
    library, begin = shop(spark, sf_dir, orders)
    made = replay(orders, begin + FITS[:fits], library)
    assert reads() == 1 and library.states.written == 1
    assert made.count() > 0 and reads() == 1


def test_all_operations_read_the_source_as_often_as_their_first_fits(spark, sf_dir, counted):
    """Mean and median before the join read it, the written join once more; nothing behind it does."""
    from workload import recipes

    orders, reads = counted
    steps = [Step(kind, p) for kind, p in recipes.ALL_OPERATIONS]
    library = recipes._library(spark, sf_dir)
    replay(orders, steps[:10], library)
    before = reads()
    replay(orders, steps[:12], library)
    at_first = reads() - before
    replay(orders, steps, library)
    assert reads() == before + at_first and library.states.written == 2


def test_a_fork_starts_at_the_longest_written_prefix(spark, sf_dir, counted):
    orders, reads = counted
    library, begin = shop(spark, sf_dir, orders)
    replay(orders, begin + FITS, library)
    forked = replay(orders, begin + FITS[:3] + [step("Delete Column", columns=["balance"])], library)
    assert reads() == 1 and library.states.written == 1
    assert rows(forked) == rows(replay(orders, begin + FITS[:3] + [step("Delete Column", columns=["balance"])], Library(library.datasets, library.versions)))


def test_another_source_or_another_merged_recipe_has_states_of_its_own(spark, sf_dir, counted):
    orders, reads = counted
    library, begin = shop(spark, sf_dir, orders)
    one = replay(orders, begin + FITS[:3], library)
    library.versions["good"] = shop(spark, sf_dir, orders, [step("Filter Rows", condition="c_custkey % 2 = 0")])[0].versions["good"]
    two = replay(orders, begin + FITS[:3], library)
    three = replay(orders.filter("o_orderkey % 2 = 0"), begin + FITS[:3], library)
    assert library.states.written == 3
    assert one.count() > two.count() > 0 and three.count() < one.count()


def test_a_fitted_merge_applies_without_a_job(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0)], "k bigint, a bigint")
    right = spark.createDataFrame([(1, 1), (3, 1)], "k bigint, b bigint")
    library = Library({"r": right}, {"v": ("r", [])})
    recipe_ = fit_recipe(left, [step("Merge Datasets", merge_with="r", merge_version="v", join_column="k", join_type="outer")], library)
    spark.sparkContext.setJobGroup("applied", "no job may run")
    try:
        out = recipe_.apply(left.limit(10))
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("applied")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == 11


def test_a_column_without_a_type_is_not_written(spark, sales):
    made = replay(sales, [step("Add Calculated Column", new_column="void", formula="NULL"), step("Filter Rows", condition="id > 1"), step("Scale Data", columns=["amount"], method="StandardScaler"), step("Remove Outliers", column="amount", method="IQR Method")])
    assert made.count() == 3
