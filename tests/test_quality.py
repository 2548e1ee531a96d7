"""Rules at their edges: bounds, nulls, empty tables, errors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabloom.operators import quality
from tabloom.operators.quality import CUSTOM, HIGH, NULL, RANGE, UNIQUE, Rule


def failed(df, *rules):
    return [(r["rule_name"], r["severity"], r["failed_rows"]) for r in quality.violations(df, list(rules))]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(-5, 1, "a"), (0, 1, "b"), (5, None, "c"), (10, None, None)], "x int, y int, t string")


def test_range_is_exclusive_by_default(numbers):
    assert failed(numbers, Rule("r", RANGE, "x", lower=-5, upper=10)) == [("r", "Error", 2)]
    assert failed(numbers, Rule("r", RANGE, "x", lower=-5, upper=10, inclusive=True)) == []
    assert failed(numbers, Rule("r", RANGE, "y", "Warning", lower=0, upper=2)) == [("r", "Warning", 2)]
    assert failed(numbers, Rule("r", RANGE, "x", lower=10, upper=-5)) == [("r", "Error", 4)]


def test_range_without_bounds_is_a_rule_error(numbers):
    [(name, severity, rows)] = failed(numbers, Rule("r", RANGE, "x"))
    assert (name, severity, rows) == ("r", HIGH, None)


@pytest.mark.parametrize("nulls, surplus", [(0, 0), (1, 0), (2, 1)])
def test_uniqueness_allows_one_null(spark, nulls, surplus):
    df = spark.createDataFrame([(i,) for i in range(5)] + [(None,)] * nulls, "k bigint")
    assert [f[2] for f in failed(df, Rule("u", UNIQUE, "k"))] == ([surplus] if surplus else [])


def test_two_unique_rules_on_one_column(numbers):
    rules = [Rule("a", UNIQUE, "y"), Rule("b", UNIQUE, "y", "Warning"), Rule("c", UNIQUE, "x")]
    assert failed(numbers, *rules) == [("a", "Error", 2), ("b", "Warning", 2)]


def test_empty_table_passes(numbers):
    rules = [Rule("r", RANGE, "x", lower=0, upper=1), Rule("u", UNIQUE, "x"), Rule("n", NULL, "t"), Rule("c", CUSTOM, "x", condition="x > 1")]
    assert failed(numbers.limit(0), *rules) == []
    assert quality.check_rules(numbers, []).count() == 0


def test_errors_are_verdicts(numbers):
    rules = [
        Rule("gone", NULL, "gone"),
        Rule("empty", CUSTOM, "x", condition=""),
        Rule("broken", CUSTOM, "x", condition="x >"),
        Rule("unknown", "No Such Check", "x"),
        Rule("number", CUSTOM, "x", condition="x"),
        Rule("fine", NULL, "x"),
    ]
    found = {r["rule_name"]: r for r in quality.violations(numbers, rules)}
    assert set(found) == {"gone", "empty", "broken", "unknown", "number"}
    assert found["gone"]["message"].startswith("Column 'gone' not found.")
    assert all(found[n]["severity"] == HIGH for n in ("gone", "empty", "broken", "unknown"))
    assert found["empty"]["message"] == "Error applying rule: empty condition"
    assert found["number"]["failed_rows"] == 1  # a number counts as true unless it is zero


def test_callable_never_sees_null(numbers):
    assert failed(numbers, Rule("c", CUSTOM, "t", condition=lambda t: t < "c")) == [("c", "Error", 2)]


def test_only_the_failing_callable_is_an_error(numbers):
    rules = [Rule("ok", NULL, "y"), Rule("boom", CUSTOM, "x", condition=lambda v: 1 / v > 0)]
    found = failed(numbers, *rules)
    assert found == [("ok", "Error", 2), ("boom", HIGH, None)]


def test_broken_callables_are_verdicts_of_the_one_scan(spark, sf_dir):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        reads.add(1)
        return True

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rules = []
    for i in range(200):
        if i % 10 == 3:
            rules.append(Rule(f"r{i}", CUSTOM, "event_id", condition=lambda v, i=i: 1 / (v % 50 - i % 50) > -2))
        elif i % 10 == 4:
            rules.append(Rule(f"r{i}", CUSTOM, "value", condition=lambda v, i=i: v > i))
        else:
            rules.append(Rule(f"r{i}", RANGE, "value", lower=0, upper=i))
    found = quality.violations(events.filter(seen("event_id")), rules)
    assert reads.value == events.count()
    broken = {f["rule_name"]: f["message"] for f in found if f["failed_rows"] is None}
    assert broken == {f"r{i}": "Error applying rule: ZeroDivisionError: division by zero" for i in range(3, 200, 10)}
    values = [r.value for r in events.collect()]
    want = {f"r{i}": sum(not v > i for v in values) if i % 10 == 4 else sum(not 0 < v < i for v in values) for i in range(200) if i % 10 != 3}
    assert {f["rule_name"]: f["failed_rows"] for f in found if f["failed_rows"] is not None} == {k: n for k, n in want.items() if n}


def test_callables_over_batches(spark):
    import pyarrow.compute as pc

    df = spark.createDataFrame([(i if i % 4 else None, [i], f"t{i % 3}") for i in range(40)], "x int, l array<int>, t string").repartition(3)
    calls = spark.sparkContext.accumulator(0)

    def counted(v):
        calls.add(1)
        return v != "t1"

    rules = [
        Rule("batch", CUSTOM, "x", condition=lambda a: pc.less(a, 20), batch=True), Rule("list", CUSTOM, "x", condition=lambda a: [v.as_py() < 10 for v in a], batch=True),
        Rule("short", CUSTOM, "x", condition=lambda a: [True], batch=True), Rule("nested", CUSTOM, "l", condition=lambda v: v[0] < 39), Rule("text", CUSTOM, "t", condition=counted),
        Rule("none", CUSTOM, "t", condition=lambda v: None),
    ]
    found = {f["rule_name"]: (f["severity"], f["failed_rows"]) for f in quality.violations(df, rules)}
    assert found == {"batch": ("Error", 25), "list": ("Error", 33), "short": (HIGH, None), "nested": ("Error", 1), "text": ("Error", 13), "none": ("Error", 40)}
    assert calls.value <= 3 * 3
    assert quality.failing_rows(df, rules[0]).count() == 25
    with pytest.raises(Exception, match="rule 'short'"):
        quality.failing_rows(df, rules[2]).collect()


def test_runtime_error_in_an_expression(numbers):
    found = quality.violations(numbers, [Rule("n", NULL, "y"), Rule("div", CUSTOM, "x", condition="1 / x > 0")])
    assert [(f["rule_name"], f["severity"]) for f in found] == [("n", "Error"), ("div", HIGH)]


def test_runtime_errors_in_checks_and_reports(numbers):
    rules = [Rule("n", NULL, "y"), Rule("div", CUSTOM, "x", condition="1 / x > 0"), Rule("m", NULL, "y")]
    assert [(r["rule_order"], r["severity"]) for r in quality.check_rules(numbers, rules).collect()] == [(0, "Error"), (1, HIGH), (2, "Error")]
    assert {tuple(r) for r in quality.report(numbers, rules).collect()} == {("Error", 2), (HIGH, 1)}


def test_failing_rows(numbers):
    bad = quality.failing_rows(numbers, Rule("r", RANGE, "x", lower=-1, upper=6))
    assert sorted(r["x"] for r in bad.collect()) == [-5, 10]


def test_report(numbers):
    rules = [Rule("a", NULL, "y", "Warning"), Rule("b", NULL, "t", "Warning"), Rule("c", NULL, "gone")]
    assert {tuple(r) for r in quality.report(numbers, rules).collect()} == {("Warning", 2), (HIGH, 1)}
    assert quality.report(numbers, [Rule("x", NULL, "x")]).count() == 0


def test_row_rules_share_one_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rules = [Rule(f"r{i}", RANGE, "value", lower=0, upper=i) for i in range(200)] + [Rule("n", NULL, "user_id")]
    plan = quality.rule_scan(events, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "props" not in plan


def test_many_rules_keep_their_order(numbers):
    rules = [Rule(f"r{i}", RANGE, "x", lower=-100, upper=i) for i in range(8)]
    assert failed(numbers, *rules) == [(f"r{i}", "Error", sum(v >= i for v in (-5, 0, 5, 10))) for i in range(8)]


def test_stored_rules(spark):
    definitions = spark.createDataFrame(
        [(1, 7, "range", RANGE, "lambda x: -5.5 <= x <= 1e3", "Error", ["a", "b"], "${col_name}: ${col_name} is bad"),
         (2, 8, "other", NULL, "", "Warning", ["a"], "m")],
        "id int, dataset_id int, rule_name string, rule_type string, condition string, severity string, "
        "target_columns array<string>, message string",
    )
    rules = quality.load_rules(quality.fan_out(definitions), 7)
    assert [(r.target_column, r.lower, r.upper, r.message) for r in rules] == [
        ("a", -5.5, 1000.0, "a: a is bad"),
        ("b", -5.5, 1000.0, "b: b is bad"),
    ]


def test_unreadable_bounds_are_null(spark):
    texts = ["lambda x: x > 3", "lambda x: a <= x <= 3", "", "lambda value: 1 < value < 2"]
    df = spark.createDataFrame([(t,) for t in texts], "condition string")
    found = {r["condition"]: (r["lower"], r["upper"]) for r in quality.parse_bounds(df).collect()}
    assert found == {texts[0]: (None, None), texts[1]: (None, None), texts[2]: (None, None), texts[3]: (1.0, 2.0)}


def test_nested_columns_can_be_checked_for_repeats(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2],), ([3],)], "a array<int>")
    assert failed(df, Rule("u", UNIQUE, "a")) == [("u", "Error", 1)]
    assert df.select(F.size("a")).count() == 3
