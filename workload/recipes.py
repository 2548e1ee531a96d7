"""Recipes, versions and the step log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.operators.profile import column_summary
from tabloom.plans import versions
from tabloom.plans.recipe import Library, Step, fit_recipe, replay, replay_version
from tabloom.session import scratch_path
from workload.registry import query, rounded, table

# Dataset ids of the driver's tables and version ids used below
EVENTS, CUSTOMER, ORDERS = 1, 2, 3
CUSTOMER_PLAIN, CUSTOMER_GOOD, EVENTS_BASE = 20, 21, 10


def _library(spark: SparkSession, sf_dir: str) -> Library:
    names = {EVENTS: "events", CUSTOMER: "customer", ORDERS: "orders"}
    return Library(
        datasets={i: (lambda n=n: table(spark, sf_dir, n)) for i, n in names.items()},
        versions={
            CUSTOMER_PLAIN: (CUSTOMER, []),
            CUSTOMER_GOOD: (
                CUSTOMER,
                [
                    Step("Filter Rows", {"condition": "c_acctbal > 0"}),
                    Step("Rename Column", {"old_name": "c_acctbal", "new_name": "balance"}),
                    Step("Delete Column", {"columns": ["c_name"]}),
                ],
            ),
            EVENTS_BASE: (
                EVENTS,
                [
                    Step("Rename Column", {"old_name": "user_id", "new_name": "c_custkey"}),
                    Step(
                        "Merge Datasets",
                        {"merge_with": CUSTOMER, "merge_version": CUSTOMER_GOOD, "join_column": "c_custkey", "join_type": "inner"},
                    ),
                ],
            ),
        },
    )


FLAGSHIP = [
    Step("Filter Rows", {"condition": "event_type <> 'error'"}),
    Step("Add Calculated Column", {"new_column": "score", "formula": "value * 2 + 1"}),
    Step("Rename Column", {"old_name": "user_id", "new_name": "c_custkey"}),
    Step(
        "Merge Datasets",
        {"merge_with": CUSTOMER, "merge_version": CUSTOMER_PLAIN, "join_column": "c_custkey", "join_type": "inner"},
    ),
    Step("Remove Outliers", {"column": "score", "method": "IQR Method"}),
    Step("Replace Values", {"column": "event_type", "to_replace": "view", "replace_with": "page_view"}),
]

_NUMBERS = ("mean", "median", "mode", "std", "min", "max")


@query(
    "recipe_replay",
    """WITH j AS (SELECT value * 2 + 1 AS score FROM events JOIN customer ON user_id = c_custkey WHERE event_type <> 'error'),
            q AS (SELECT quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.75) AS b FROM j),
            k AS (SELECT score FROM j, q WHERE score BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))
       SELECT 'score' AS column_name, 'double' AS data_type, count(DISTINCT score) AS unique_values,
              count(*) - count(score) AS missing_values, round(avg(score), 4) AS mean, round(median(score), 4) AS median,
              round((SELECT score FROM k GROUP BY score ORDER BY count(*) DESC, score LIMIT 1), 4) AS mode,
              round(stddev_samp(score), 4) AS std, round(min(score), 4) AS min, round(max(score), 4) AS max FROM k""",
)
def recipe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = replay(table(spark, sf_dir, "events"), FLAGSHIP, _library(spark, sf_dir))
    return rounded(column_summary(version, ["score"]), 4, *_NUMBERS)


# One step of each of the 14 operation types, as stored in a log
ALL_OPERATIONS = [
    ("Rename Column", {"old_name": "o_custkey", "new_name": "c_custkey"}),
    ("Change Data Type", {"column": "o_orderkey", "new_type": "UInt32"}),
    ("Duplicate Column", {"column": "o_totalprice"}),
    ("Replace Values", {"column": "o_orderstatus", "to_replace": "P", "replace_with": "PENDING"}),
    ("Filter Rows", {"condition": "o_orderpriority <> '5-LOW'"}),
    ("Add Calculated Column", {"new_column": "big", "formula": "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END"}),
    ("Add Calculated Column", {"new_column": "gap", "formula": "CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 2 END"}),
    ("Fill Missing Values", {"column": "big", "method": "Mean"}),
    ("Impute Missing Values", {"columns": ["gap"], "method": "Median"}),
    (
        "Merge Datasets",
        {"merge_with": CUSTOMER, "merge_version": CUSTOMER_GOOD, "join_column": "c_custkey", "join_type": "inner"},
    ),
    ("Remove Outliers", {"column": "big", "method": "IQR Method"}),
    ("Scale Data", {"columns": ["gap"], "method": "MinMaxScaler"}),
    ("Encode Data", {"columns": ["o_orderstatus"], "type": "OneHotEncoding"}),
    ("Encode Data", {"columns": ["c_mktsegment"], "type": "LabelEncoding"}),
    ("Delete Column", {"columns": ["o_orderdate", "o_totalprice"]}),
    (
        "Reorder Columns",
        {
            "new_order": [
                "o_orderkey", "c_custkey", "big", "gap", "balance", "c_mktsegment", "o_totalprice_duplicate",
                "o_orderstatus_O", "o_orderstatus_PENDING",
            ]
        },
    ),
]


@query(
    "recipe_all_operations",
    """WITH f AS (SELECT o_orderkey, o_custkey AS c_custkey, o_totalprice,
                         CASE WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE o_orderstatus END AS status,
                         CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS big,
                         CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 2 END AS gap
                  FROM orders WHERE o_orderpriority <> '5-LOW'),
            i AS (SELECT o_orderkey, c_custkey, o_totalprice, status, coalesce(big, (SELECT avg(big) FROM f)) AS big,
                         coalesce(gap, (SELECT median(gap) FROM f)) AS gap FROM f),
            m AS (SELECT i.*, c.c_acctbal AS balance, c.c_mktsegment FROM i JOIN customer c USING (c_custkey) WHERE c.c_acctbal > 0),
            q AS (SELECT quantile_cont(big, 0.25) AS a, quantile_cont(big, 0.75) AS b FROM m),
            o AS (SELECT m.* FROM m, q WHERE big BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)),
            s AS (SELECT min(gap) AS lo, max(gap) AS hi FROM o),
            l AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM o))
       SELECT o_orderkey, c_custkey, round(big, 4) AS big, round((gap - lo) / (hi - lo), 6) AS gap, balance,
              l.code AS c_mktsegment, o_totalprice AS o_totalprice_duplicate,
              CASE WHEN status = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS "o_orderstatus_O",
              CASE WHEN status = 'PENDING' THEN 1.0 ELSE 0.0 END::DOUBLE AS "o_orderstatus_PENDING"
       FROM o JOIN l USING (c_mktsegment), s""",
)
def recipe_all_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [Step.from_json(kind, json.dumps(parameters)) for kind, parameters in ALL_OPERATIONS]
    version = replay(table(spark, sf_dir, "orders"), steps, _library(spark, sf_dir))
    return rounded(rounded(version, 4, "big"), 6, "gap")


_MERGED = """SELECT event_id, ts, user_id AS c_custkey, event_type, value, props, c_nationkey, c_acctbal AS balance, c_mktsegment
             FROM events JOIN customer ON user_id = c_custkey WHERE c_acctbal > 0"""


@query(
    "merge_version",
    f"""SELECT o_orderkey, c_custkey, o_totalprice, event_id, balance
        FROM (SELECT o_orderkey, o_custkey AS c_custkey, o_totalprice FROM orders) LEFT JOIN ({_MERGED}) USING (c_custkey)""",
)
def merge_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges with a version that itself merges with a version."""
    steps = [
        Step("Rename Column", {"old_name": "o_custkey", "new_name": "c_custkey"}),
        Step(
            "Merge Datasets",
            {"merge_with": EVENTS, "merge_version": EVENTS_BASE, "join_column": "c_custkey", "join_type": "left"},
        ),
        Step("Reorder Columns", {"new_order": ["o_orderkey", "c_custkey", "o_totalprice", "event_id", "balance"]}),
    ]
    return replay(table(spark, sf_dir, "orders"), steps, _library(spark, sf_dir))


@query("version_materialise", _MERGED)
def version_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = _library(spark, sf_dir)
    return versions.materialise(
        library.dataset(EVENTS), library.steps(EVENTS, EVENTS_BASE), scratch_path(spark, "versions"), "events",
        "with customers", library,
    )


@query("version_replay", _MERGED)
def version_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_version(_library(spark, sf_dir), EVENTS, EVENTS_BASE)


@query(
    "recipe_apply_fitted",
    """WITH t AS (SELECT avg(value) AS m, stddev_pop(value) AS d, min(value) AS lo, max(value) AS hi FROM events WHERE event_type <> 'error')
       SELECT event_id, round((value - m) / d, 6) + 0.0 AS value FROM events, t WHERE event_type = 'error'""",
)
def recipe_apply_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe learnt on some rows and applied to others."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    recipe = fit_recipe(
        events.filter("event_type <> 'error'"),
        [Step("Scale Data", {"columns": ["value"], "method": "StandardScaler"}), Step("Delete Column", {"columns": ["event_type"]})],
    )
    return rounded(recipe.apply(events.filter("event_type = 'error'")), 6, "value")


# The events table read as a log: purchases belong to version 2, the rest to version 1
_LOG = """SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS version_id,
                 event_type AS operation_type, props AS parameters FROM events"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "purchase", 2).otherwise(1).cast("bigint").alias("version_id"),
        F.col("event_type").alias("operation_type"),
        F.col("props").alias("parameters"),
    )


@query(
    "operation_log",
    f"""SELECT id, operation_type, CAST(json_extract_string(parameters, '$.k') AS BIGINT) AS k FROM ({_LOG})
        WHERE version_id = 1 AND id NOT IN (SELECT event_id FROM events WHERE value > 20)""",
)
def operation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = table(spark, sf_dir, "events").filter("value > 20").select(F.col("event_id").alias("id"))
    live = versions.step_log(_log(spark, sf_dir), 1, removed)
    return live.select("id", "operation_type", F.from_json("parameters", "k bigint")["k"].alias("k")).orderBy("id")


@query(
    "version_from_base",
    f"""WITH l AS ({_LOG}), t AS (SELECT max(id) + 1 AS following, min(id) FILTER (version_id = 1) AS b0, max(id) FILTER (version_id = 1) AS b1,
                  min(id) FILTER (version_id = 2) AS a0 FROM l)
        SELECT id - b0 + following AS id, 3::BIGINT AS version_id, operation_type, parameters FROM l, t WHERE version_id = 1
        UNION ALL SELECT id - a0 + following + b1 - b0 + 1, 3::BIGINT, operation_type, parameters FROM l, t WHERE version_id = 2""",
)
def version_from_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return versions.version_from_base(log, 1, 3, added=versions.step_log(log, 2))
