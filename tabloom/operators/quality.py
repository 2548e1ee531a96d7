"""Data-quality rules compiled into a few aggregates.

Callables see whole Arrow batches: each is called once for every distinct value of a batch, or once with
the batch, and gives back which values pass and its first error. Both are aggregated beside the other
rules, so a rule that breaks on a row is a verdict of the same scan. An SQL predicate that breaks fails
the scan; then halves of the rules are tried.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import col
from tabloom.functions.stats import value_counts_by_column

# Rule types, severities and the texts of the two failure messages
RANGE, NULL, UNIQUE, CUSTOM = "Range Check", "Null Check", "Uniqueness Check", "Custom Lambda"
WARNING, ERROR, HIGH = "Warning", "Error", "High"
NO_COLUMN = "Column '{column}' not found. It may have been dropped during data manipulation."
FAILED = "Error applying rule: {reason}"

CHECKED = "__tabloom_checked"
RESULT = "rule_order int, rule_name string, column_name string, severity string, message string, failed_rows bigint"


class RuleError(ValueError):
    """A rule that cannot be evaluated."""


@dataclass(frozen=True)
class Rule:
    """One check of one column.

    ``condition`` is a SQL predicate or a callable per value for custom rules, with ``batch`` one that
    takes an Arrow array without nulls and returns a truth value for each of its values; a
    range rule carries its bounds and compares exclusively unless told otherwise.
    """

    rule_name: str
    rule_type: str
    target_column: str
    severity: str = ERROR
    message: str = ""
    lower: float | None = None
    upper: float | None = None
    inclusive: bool = False
    condition: str | Callable[[Any], Any] = ""
    batch: bool = False


def row_test(df: DataFrame, rule: Rule) -> Column:
    """True where the row passes; a null result counts as a failure."""
    value = col(rule.target_column)
    if rule.rule_type == RANGE:
        if rule.lower is None or rule.upper is None:
            raise RuleError("a range rule needs both bounds")
        low, high = F.lit(rule.lower), F.lit(rule.upper)
        test = (value >= low) & (value <= high) if rule.inclusive else (value > low) & (value < high)
    elif rule.rule_type == NULL:
        test = value.isNotNull()
    elif rule.rule_type == CUSTOM:
        test = _custom(value, rule)
    else:
        raise RuleError(f"no row test for rule type '{rule.rule_type}'")
    test = F.coalesce(test.cast("boolean"), F.lit(False))
    df.select(test)  # analysis finds bad expressions here, without running anything
    return test


def _custom(value: Column, rule: Rule) -> Column:
    if callable(rule.condition):
        checked = _checker([rule])(value)
        broken = F.concat(F.lit(f"rule '{rule.rule_name}': "), checked["error0"])
        return F.when(checked["error0"].isNotNull(), F.raise_error(broken).cast("boolean")).otherwise(checked["passed0"])
    if not rule.condition.strip():
        raise RuleError("empty condition")
    return F.expr(rule.condition)


def _passed(values: pa.Array, rule: Rule) -> tuple[pa.Array, str | None]:
    """Which values pass (a null never does), and the error that ended the check, if one did."""
    present = values.drop_null()
    if pa.types.is_nested(values.type) or rule.batch:
        distinct, at = present, None
    else:
        coded = present.dictionary_encode()
        distinct, at = coded.dictionary, coded.indices
    try:
        answers = rule.condition(distinct) if rule.batch else [rule.condition(v) for v in distinct.to_pylist()]
        truth = pa.array([bool(x) for x in (answers.to_pylist() if isinstance(answers, (pa.Array, pa.ChunkedArray)) else answers)], pa.bool_())
        if len(truth) != len(distinct):
            raise RuleError(f"{len(truth)} answers for {len(distinct)} values")
    except Exception as error:  # a rule may break in any way
        return pa.array([False] * len(values), pa.bool_()), f"{type(error).__name__}: {error}".split("\n")[0]
    truth = truth if at is None else truth.take(at)
    return pc.replace_with_mask(pa.array([False] * len(values), pa.bool_()), values.is_valid(), truth), None


def _checker(rules: list[Rule]) -> Callable[..., Column]:
    """A function of the rules' columns to ``passed<i>`` and ``error<i>`` of each rule."""

    def check(*columns: pa.Array) -> pa.Array:
        fields: dict[str, pa.Array] = {}
        for i, (values, rule) in enumerate(zip(columns, rules)):
            fields[f"passed{i}"], error = _passed(values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values, rule)
            fields[f"error{i}"] = pa.array([error] + [None] * (len(values) - 1) if len(values) else [], pa.string())
        return pa.StructArray.from_arrays(list(fields.values()), list(fields))

    return F.arrow_udf(check, ", ".join(f"passed{i} boolean, error{i} string" for i in range(len(rules))))


def _verdict(order: int, rule: Rule, failed: Column, severity: str | None = None, message: str | Column | None = None) -> Column:
    return F.struct(
        F.lit(order).alias("rule_order"),
        F.lit(rule.rule_name).alias("rule_name"),
        F.lit(rule.target_column).alias("column_name"),
        F.lit(severity or rule.severity).alias("severity"),
        (message if isinstance(message, Column) else F.lit(rule.message if message is None else message)).alias("message"),
        failed.cast("bigint").alias("failed_rows"),
    )


def rule_scan(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The failed rules as one lazy table, for ``check_rules``.

    Range, null and custom rules share one scan, whatever their number. Uniqueness
    rules share one shuffle of value counts, combined on the map side. A callable that
    breaks on a row is an error of its rule, an SQL predicate fails the whole table.
    """
    row_rules: list[tuple[int, Rule, Column]] = []
    called: list[tuple[int, Rule]] = []
    unique_rules: dict[str, list[tuple[int, Rule]]] = {}
    broken: list[Column] = []
    for order, rule in enumerate(rules):
        if rule.target_column not in df.columns:
            broken.append(_verdict(order, rule, F.lit(None), HIGH, NO_COLUMN.format(column=rule.target_column)))
        elif rule.rule_type == UNIQUE:
            unique_rules.setdefault(rule.target_column, []).append((order, rule))
        elif rule.rule_type == CUSTOM and callable(rule.condition):
            called.append((order, rule))
        else:
            try:
                row_rules.append((order, rule, row_test(df, rule)))
            except (RuleError, PySparkException) as error:
                broken.append(_verdict(order, rule, F.lit(None), HIGH, FAILED.format(reason=_reason(error))))

    parts = []
    if row_rules or called:
        verdicts = [_verdict(order, rule, F.count_if(~test)) for order, rule, test in row_rules]
        rows = df
        if called:
            checked = _checker([rule for _, rule in called])(*[col(rule.target_column) for _, rule in called])
            rows = df.withColumn(CHECKED, checked)
        for i, (order, rule) in enumerate(called):
            passed, error = F.col(f"{CHECKED}.passed{i}"), F.min(f"{CHECKED}.error{i}")
            counted = _verdict(order, rule, F.count_if(~passed))
            stopped = _verdict(order, rule, F.lit(None), HIGH, F.concat(F.lit(FAILED.format(reason="")), error))
            verdicts.append(F.when(error.isNull(), counted).otherwise(stopped))
        found = rows.agg(F.array(*verdicts).alias("v")).select(F.inline("v"))
        parts.append(found.filter("failed_rows > 0 OR failed_rows IS NULL"))
    for _, counts in value_counts_by_column(df, unique_rules):
        surplus = counts.groupBy("name").agg((F.sum("n") - F.count(F.lit(1))).alias("surplus")).filter("surplus > 0")
        verdicts = [
            F.when(F.col("name") == column, F.array(*[_verdict(o, r, F.col("surplus")) for o, r in of_column]))
            for column, of_column in unique_rules.items()
        ]
        parts.append(surplus.select(F.inline(F.coalesce(*verdicts))))
    if broken or not parts:
        one = df.sparkSession.range(1)
        empty = df.sparkSession.createDataFrame([], RESULT)
        parts.append(one.select(F.inline(F.array(*broken))) if broken else empty)
    return reduce(DataFrame.unionByName, parts)


def _reason(error: Exception) -> str:
    return str(error).split("\n")[0]


def violations(df: DataFrame, rules: list[Rule]) -> list[dict[str, Any]]:
    """The failed rules in rule order, as records.

    If the shared pass breaks at run time (an SQL predicate divides by zero, say), halves of
    the rules are tried until only the culprits are left to be reported as errors.
    """
    return sorted(_checked(df, list(enumerate(rules))), key=lambda r: r["rule_order"])


def _checked(df: DataFrame, numbered: list[tuple[int, Rule]]) -> list[dict[str, Any]]:
    try:
        rows = rule_scan(df, [rule for _, rule in numbered]).collect()
        return [{**r.asDict(), "rule_order": numbered[r["rule_order"]][0]} for r in rows]
    except (PySparkException, Py4JJavaError) as error:
        if len(numbered) > 1:
            half = len(numbered) // 2
            return _checked(df, numbered[:half]) + _checked(df, numbered[half:])
        order, rule = numbered[0]
        return [
            {
                "rule_order": order,
                "rule_name": rule.rule_name,
                "column_name": rule.target_column,
                "severity": HIGH,
                "message": FAILED.format(reason=_reason(error)),
                "failed_rows": None,
            }
        ]


def check_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per failed rule: order, name, column, severity, message, failed rows.

    ``failed_rows`` of a uniqueness rule is the number of surplus rows. A missing
    column, a rule that cannot be compiled and a rule that breaks on a row give a
    verdict of severity High (``failed_rows`` is null). The rules run at once, as
    only that shows which SQL predicates break.
    """
    names = [part.split()[0] for part in RESULT.split(", ")]
    return df.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in violations(df, rules)], RESULT)


def report(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(severity, violations)``; no rows means no issues."""
    return check_rules(df, rules).groupBy("severity").agg(F.count(F.lit(1)).alias("violations"))


def failing_rows(df: DataFrame, rule: Rule) -> DataFrame:
    """The rows that break a range, null or custom rule."""
    return df.filter(~row_test(df, rule))


# -- stored rules -------------------------------------------------------------

def fan_out(definitions: DataFrame) -> DataFrame:
    """One rule row per entry of ``target_columns``, ``${col_name}`` filled in the message."""
    return definitions.withColumn("target_column", F.explode("target_columns")).select(
        *[c for c in definitions.columns if c not in ("target_columns", "message")],
        "target_column",
        F.replace("message", F.lit("${col_name}"), F.col("target_column")).alias("message"),
    )


# A stored range condition reads "lambda x: <lower> <= x <= <upper>"
NUMBER = r"(-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)"
STORED_RANGE = rf"^\s*lambda\s+\w+\s*:\s*{NUMBER}\s*<=?\s*\w+\s*<=?\s*{NUMBER}\s*$"


def parse_bounds(rules: DataFrame) -> DataFrame:
    """Add ``lower`` and ``upper`` read from stored range conditions (null if not one)."""
    bound = lambda group: F.regexp_extract("condition", STORED_RANGE, group).try_cast("double")
    return rules.withColumns({"lower": bound(1), "upper": bound(2)})


def load_rules(stored: DataFrame, dataset_id: int) -> list[Rule]:
    """The rules of one dataset, in id order, from a stored rule table."""
    rows = parse_bounds(stored.filter(F.col("dataset_id") == dataset_id)).orderBy("id").collect()
    return [
        Rule(
            r["rule_name"],
            r["rule_type"],
            r["target_column"],
            r["severity"],
            r["message"] or "",
            r["lower"],
            r["upper"],
            condition=r["condition"] or "",
        )
        for r in rows
    ]
