"""Data-quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.operators import quality
from tabloom.operators.quality import CUSTOM, NULL, RANGE, UNIQUE, Rule
from workload.registry import query, sql_nulls, table, with_nulls

_EVENTS = f"SELECT event_id, event_type, {sql_nulls('value', 'event_id', 7)} AS value, user_id FROM events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", with_nulls("value", "event_id", 7).alias("value"), "user_id"
    )


def _sql_verdicts(source: str, *verdicts: tuple[int, str, str, str, str, str]) -> str:
    """One row per failed rule from (order, name, column, severity, message, failed expression)."""
    rows = " UNION ALL ".join(
        f"""SELECT {order}::INTEGER AS rule_order, '{name}' AS rule_name, '{column}' AS column_name, '{severity}' AS severity,
            '{message}' AS message, ({failed})::BIGINT AS failed_rows FROM s"""
        for order, name, column, severity, message, failed in verdicts
    )
    return f"WITH s AS ({source}) SELECT * FROM ({rows}) WHERE failed_rows > 0 OR failed_rows IS NULL"


_RANGE_FAILS = "count_if(NOT coalesce(value > 0 AND value < 20, false))"


@query("dq_range", _sql_verdicts(_EVENTS, (0, "r", "value", "Error", "value out of range", _RANGE_FAILS)))
def dq_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("r", RANGE, "value", "Error", "value out of range", lower=0, upper=20)
    return quality.check_rules(_events(spark, sf_dir), [rule])


@query("dq_null", _sql_verdicts(_EVENTS, (1, "n", "value", "Warning", "value missing", "count_if(value IS NULL)")))
def dq_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Rule("k", NULL, "event_id"), Rule("n", NULL, "value", "Warning", "value missing")]
    return quality.check_rules(_events(spark, sf_dir), rules)


def _sql_surplus(column: str) -> str:
    return f"count(*) - count(DISTINCT {column}) - max(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END)"


@query(
    "dq_unique",
    _sql_verdicts(
        _EVENTS,
        (0, "id", "event_id", "Error", "", _sql_surplus("event_id")),
        (1, "user", "user_id", "Error", "user repeats", _sql_surplus("user_id")),
        (2, "value", "value", "Warning", "value repeats", _sql_surplus("value")),
        (3, "type", "event_type", "Warning", "type repeats", _sql_surplus("event_type")),
    ),
)
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        Rule("id", UNIQUE, "event_id"),
        Rule("user", UNIQUE, "user_id", "Error", "user repeats"),
        Rule("value", UNIQUE, "value", "Warning", "value repeats"),
        Rule("type", UNIQUE, "event_type", "Warning", "type repeats"),
    ]
    return quality.check_rules(_events(spark, sf_dir), rules)


_CUSTOM_FAILS = "count_if(NOT coalesce(value < 20 OR event_type = 'purchase', false))"


@query("dq_custom_expr", _sql_verdicts(_EVENTS, (0, "c", "value", "Error", "large value", _CUSTOM_FAILS)))
def dq_custom_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("c", CUSTOM, "value", "Error", "large value", condition="value < 20 OR event_type = 'purchase'")
    return quality.check_rules(_events(spark, sf_dir), [rule])


@query(
    "dq_custom_udf",
    _sql_verdicts(_EVENTS, (0, "u", "value", "Error", "small value", "count_if(NOT coalesce(value > 10, false))")),
)
def dq_custom_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("u", CUSTOM, "value", "Error", "small value", condition=lambda v: v > 10)
    return quality.check_rules(_events(spark, sf_dir), [rule])


@query(
    "dq_empty_table",
    """SELECT 0::INTEGER AS rule_order, '' AS rule_name, '' AS column_name, '' AS severity, '' AS message,
              0::BIGINT AS failed_rows FROM events WHERE value < 0""",
)
def dq_empty_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = _events(spark, sf_dir).filter("value < 0")
    return quality.check_rules(nothing, [Rule("n", NULL, "value"), Rule("u", UNIQUE, "user_id")])


_NO_COLUMN = "Column ''gone'' not found. It may have been dropped during data manipulation."


@query(
    "dq_missing_column",
    _sql_verdicts(
        _EVENTS,
        (0, "n", "value", "Error", "value missing", "count_if(value IS NULL)"),
        (1, "g", "gone", "High", _NO_COLUMN, "any_value(NULL)"),
    ),
)
def dq_missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Rule("n", NULL, "value", "Error", "value missing"), Rule("g", NULL, "gone", "Warning", "never seen")]
    return quality.check_rules(_events(spark, sf_dir), rules)


@query(
    "dq_rule_error",
    _sql_verdicts(
        _EVENTS,
        (0, "e", "value", "High", "Error applying rule: empty condition", "any_value(NULL)"),
        (1, "b", "value", "High", "Error applying rule", "any_value(NULL)"),
        (2, "n", "value", "Error", "value missing", "count_if(value IS NULL)"),
        (3, "z", "value", "High", "Error applying rule", "any_value(NULL)"),
    ),
)
def dq_rule_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        Rule("e", CUSTOM, "value", condition=" "),
        Rule("b", CUSTOM, "value", condition="no_such_column > 1"),
        Rule("n", NULL, "value", "Error", "value missing"),
        Rule("z", CUSTOM, "value", condition="1 / (event_id - event_id) > 0"),
    ]
    verdicts = quality.check_rules(_events(spark, sf_dir), rules)
    # the wording of what follows belongs to Spark
    return verdicts.withColumn(
        "message", F.when(F.col("rule_name").isin("b", "z"), F.split("message", ":")[0]).otherwise(F.col("message"))
    )


_MANY = [
    Rule("range", RANGE, "value", "Error", "value out of range", lower=0, upper=20),
    Rule("present", NULL, "value", "Warning", "value missing"),
    Rule("unique id", UNIQUE, "event_id", "Error", "id repeats"),
    Rule("unique user", UNIQUE, "user_id", "Warning", "user repeats"),
    Rule("custom", CUSTOM, "value", "Error", "large value", condition="value < 20 OR event_type = 'purchase'"),
    Rule("dropped", NULL, "gone", "Warning", "never seen"),
    Rule("inclusive", RANGE, "user_id", "Error", "user out of range", lower=0, upper=1e9, inclusive=True),
]
_SQL_MANY = _sql_verdicts(
    _EVENTS,
    (0, "range", "value", "Error", "value out of range", _RANGE_FAILS),
    (1, "present", "value", "Warning", "value missing", "count_if(value IS NULL)"),
    (2, "unique id", "event_id", "Error", "id repeats", _sql_surplus("event_id")),
    (3, "unique user", "user_id", "Warning", "user repeats", _sql_surplus("user_id")),
    (4, "custom", "value", "Error", "large value", _CUSTOM_FAILS),
    (5, "dropped", "gone", "High", _NO_COLUMN, "any_value(NULL)"),
    (6, "inclusive", "user_id", "Error", "user out of range", "count_if(NOT user_id BETWEEN 0 AND 1000000000)"),
)


@query("dq_violations", _SQL_MANY)
def dq_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_rules(_events(spark, sf_dir), _MANY)


@query("dq_report", f"SELECT severity, count(*) AS violations FROM ({_SQL_MANY}) GROUP BY severity")
def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_events(spark, sf_dir), _MANY)


@query("dq_failing_rows", f"SELECT * FROM ({_EVENTS}) WHERE NOT coalesce(value > 0 AND value < 20, false)")
def dq_failing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failing_rows(_events(spark, sf_dir), _MANY[0])


@query(
    "dq_rule_bounds",
    """SELECT p_partkey AS id, -p_size::DOUBLE AS lower, p_retailprice AS upper FROM part WHERE p_partkey % 2 = 0
       UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_partkey % 2 = 1""",
)
def dq_rule_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(
            F.col("p_partkey") % 2 == 0,
            F.concat(F.lit("lambda x: "), (-F.col("p_size")).cast("string"), F.lit(".0 <= x <= "), F.col("p_retailprice").cast("string")),
        )
        .otherwise(F.lit("lambda x: x > 3"))
        .alias("condition"),
    )
    return quality.parse_bounds(stored).drop("condition")


@query(
    "rule_fanout",
    """SELECT p_partkey AS id, p_name AS rule_name, c AS target_column, c || ' of ' || p_brand || ': check ' || c AS message
       FROM part, (VALUES ('p_size'), ('p_retailprice')) v(c)
       UNION ALL SELECT p_partkey, p_name, p_type, p_type || ' of ' || p_brand || ': check ' || p_type FROM part""",
)
def rule_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    definitions = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("rule_name"),
        F.concat(F.lit("${col_name} of "), "p_brand", F.lit(": check ${col_name}")).alias("message"),
        F.array(F.lit("p_size"), F.lit("p_retailprice"), F.col("p_type")).alias("target_columns"),
    )
    return quality.fan_out(definitions)
