"""Projection, filter, fill, scaling, encoding and outlier steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.operators import encode, merge, prepare, profile, project
from workload.registry import query, rounded, sql_nulls, table, with_nulls

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


# -- projection and filter ----------------------------------------------------

@query(
    "rename_column",
    "SELECT o_orderkey, o_custkey AS c_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
)
def rename_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.rename_column(table(spark, sf_dir, "orders"), "o_custkey", "c_custkey")


@query("change_type", "SELECT user_id, CAST(trunc(value) AS BIGINT) AS value FROM events")
def change_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.change_type(table(spark, sf_dir, "events").select("user_id", "value"), "value", "UInt32")


@query("delete_columns", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def delete_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.delete_columns(
        table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"]
    )


@query(
    "filter_rows",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
       WHERE l_quantity >= 18 AND l_discount < 0.05 AND l_shipdate >= DATE '1996-01-01'""",
)
def filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.filter_rows(
        table(spark, sf_dir, "lineitem"),
        "l_quantity >= 18 AND l_discount < 0.05 AND l_shipdate >= TIMESTAMP_NTZ'1996-01-01 00:00:00'",
    ).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query(
    "filter_boolean_column",
    """SELECT event_id, value, true AS is_large FROM events
       WHERE event_id % 7 <> 0 AND value > 10""",
)
def filter_boolean_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = table(spark, sf_dir, "events").select(
        "event_id", "value", F.when(F.col("event_id") % 7 != 0, F.col("value") > 10).alias("is_large")
    )
    return project.filter_rows(flagged, "is_large")


@query(
    "equality_filters",
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
)
def equality_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.equality_filters(
        table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": None}
    ).select("o_orderkey", "o_orderstatus", "o_orderpriority")


_OPTION_COLUMNS = {
    "l_orderkey": "CAST(l_orderkey AS VARCHAR)",
    "l_linenumber": "CAST(l_linenumber AS VARCHAR)",
    "l_returnflag": f"CASE WHEN l_orderkey % 7 <> 0 THEN l_returnflag END",
    "l_linestatus": "l_linestatus",
    "l_suppkey": "CAST(l_suppkey AS VARCHAR)",
}


@query(
    "filter_options",
    "WITH v AS ("
    + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS column_name, {e} AS value FROM lineitem" for c, e in _OPTION_COLUMNS.items())
    + ") SELECT column_name, value FROM v WHERE column_name IN (SELECT column_name FROM v GROUP BY column_name HAVING count(*) < 100)",
)
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", with_nulls("l_returnflag", "l_orderkey", 7).alias("l_returnflag"),
        "l_linestatus", "l_suppkey",
    )
    return profile.filter_options(lineitem)


@query(
    "calculated_column",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge
       FROM lineitem""",
)
def calculated_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    charged = project.add_calculated_column(
        table(spark, sf_dir, "lineitem"), "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)"
    )
    return rounded(charged.select("l_orderkey", "l_linenumber", "charge"), 6, "charge")


@query("duplicate_column", f"SELECT {ORDERS}, o_totalprice AS o_totalprice_duplicate FROM orders")
def duplicate_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.duplicate_column(table(spark, sf_dir, "orders"), "o_totalprice")


@query("reorder_columns", "SELECT o_totalprice, o_orderkey, o_orderstatus FROM orders")
def reorder_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.reorder_columns(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey", "o_orderstatus"])


@query(
    "replace_values",
    f"""SELECT event_id, CASE WHEN event_type = 'view' THEN 'page_view' ELSE event_type END AS event_type,
               CASE WHEN user_id = 8 THEN -1 WHEN event_id % 7 <> 0 THEN user_id END AS user_id
        FROM (SELECT event_id, event_type, {sql_nulls('user_id', 'event_id', 7)} AS user_id FROM events)""",
)
def replace_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id", "event_type", with_nulls("user_id", "event_id", 7).alias("user_id")
    )
    return project.replace_values(project.replace_values(events, "event_type", "view", "page_view"), "user_id", "8", "-1")


@query(
    "has_missing",
    f"""SELECT count(*) > count({sql_nulls('l_quantity', 'l_orderkey', 7)}) AS has_missing FROM lineitem""",
)
def has_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_tax", with_nulls("l_quantity", "l_orderkey", 7).alias("l_quantity")
    )
    return project.has_missing(lineitem, "l_tax", "l_quantity")


@query(
    "join_key_candidates",
    """WITH e AS (SELECT user_id AS c_custkey, event_type AS c_mktsegment FROM events),
            k AS (SELECT 'c_custkey' AS column_name, CAST(c_custkey AS VARCHAR) AS key, 1 AS l, 0 AS r FROM e
                  UNION ALL SELECT 'c_custkey', CAST(c_custkey AS VARCHAR), 0, 1 FROM customer
                  UNION ALL SELECT 'c_mktsegment', c_mktsegment, 1, 0 FROM e
                  UNION ALL SELECT 'c_mktsegment', c_mktsegment, 0, 1 FROM customer),
            p AS (SELECT column_name, key, max(l) AS l, max(r) AS r FROM k GROUP BY ALL)
       SELECT column_name, count(*) FILTER (l = 1) AS left_keys, count(*) FILTER (r = 1) AS right_keys,
              count(*) FILTER (l = 1 AND r = 1) AS matched_keys FROM p GROUP BY column_name""",
)
def join_key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("c_custkey"), F.col("event_type").alias("c_mktsegment")
    )
    return merge.join_key_candidates(events, table(spark, sf_dir, "customer"))


# -- missing values -----------------------------------------------------------

_GAPS = f"""SELECT l_orderkey, l_linenumber, {sql_nulls('l_quantity', 'l_orderkey', 7)} AS l_quantity,
                   {sql_nulls('l_partkey', 'l_orderkey', 5)} AS l_partkey,
                   {sql_nulls('l_extendedprice', 'l_suppkey', 3)} AS l_extendedprice,
                   {sql_nulls('l_returnflag', 'l_suppkey', 4)} AS l_returnflag
            FROM lineitem"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        with_nulls("l_quantity", "l_orderkey", 7).alias("l_quantity"),
        with_nulls("l_partkey", "l_orderkey", 5).alias("l_partkey"),
        with_nulls("l_extendedprice", "l_suppkey", 3).alias("l_extendedprice"),
        with_nulls("l_returnflag", "l_suppkey", 4).alias("l_returnflag"),
    )


def _sql_mode(column: str, source: str = "g") -> str:
    return f"""(SELECT {column} FROM {source} WHERE {column} IS NOT NULL
               GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"""


@query(
    "fill_value",
    f"""SELECT l_orderkey, l_linenumber, coalesce(l_quantity, -1.0) AS l_quantity, coalesce(l_partkey, 0) AS l_partkey,
               l_extendedprice, coalesce(l_returnflag, 'none') AS l_returnflag FROM ({_GAPS})""",
)
def fill_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prepare.fill_value(_gaps(spark, sf_dir), "l_quantity", "-1")
    return prepare.fill_value(prepare.fill_value(df, "l_partkey", 0), "l_returnflag", "none")


def _filled(spark: SparkSession, sf_dir: str, columns: list[str], method: str) -> DataFrame:
    df = prepare.impute(_gaps(spark, sf_dir), columns, method).select("l_orderkey", "l_linenumber", *columns)
    return df if method == "Mode" else rounded(df, 4, *columns)


@query(
    "fill_mean",
    f"""WITH g AS ({_GAPS}) SELECT l_orderkey, l_linenumber,
        round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM g)), 4) AS l_quantity FROM g""",
)
def fill_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, ["l_quantity"], "Mean")


@query(
    "fill_median",
    f"""WITH g AS ({_GAPS}) SELECT l_orderkey, l_linenumber,
        round(coalesce(l_extendedprice, (SELECT median(l_extendedprice) FROM g)), 4) AS l_extendedprice FROM g""",
)
def fill_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, ["l_extendedprice"], "Median")


@query(
    "fill_mode",
    f"""WITH g AS ({_GAPS}) SELECT l_orderkey, l_linenumber,
        coalesce(l_returnflag, {_sql_mode('l_returnflag')}) AS l_returnflag FROM g""",
)
def fill_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, ["l_returnflag"], "Mode")


_THREE = ["l_quantity", "l_partkey", "l_extendedprice"]


def _sql_impute(function: str) -> str:
    filled = ", ".join(f"round(coalesce({c}, (SELECT {function}({c}) FROM g)), 4) AS {c}" for c in _THREE)
    return f"WITH g AS ({_GAPS}) SELECT l_orderkey, l_linenumber, {filled} FROM g"


@query("impute_mean", _sql_impute("avg"))
def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, _THREE, "Mean")


@query("impute_median", _sql_impute("median"))
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, _THREE, "Median")


@query(
    "impute_mode",
    f"""WITH g AS ({_GAPS}) SELECT l_orderkey, l_linenumber,
        {', '.join(f"coalesce({c}, {_sql_mode(c)}) AS {c}" for c in [*_THREE, 'l_returnflag'])} FROM g""",
)
def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, [*_THREE, "l_returnflag"], "Mode")


# -- scaling and encoding -----------------------------------------------------

_SCALED = f"""SELECT l_orderkey, l_linenumber, {sql_nulls('l_quantity', 'l_orderkey', 7)} AS l_quantity,
                     l_extendedprice, 1.0::DOUBLE AS constant FROM lineitem"""


def _to_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        with_nulls("l_quantity", "l_orderkey", 7).alias("l_quantity"),
        "l_extendedprice",
        F.lit(1.0).alias("constant"),
    )


def _scaled(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    names = ["l_quantity", "l_extendedprice", "constant"]
    return rounded(prepare.scale(_to_scale(spark, sf_dir), names, method), 6, *names)


@query(
    "scale_standard",
    f"""WITH g AS ({_SCALED}), s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq,
                                          avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM g)
        SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) + 0.0 AS l_quantity,
               round((l_extendedprice - mp) / sp, 6) + 0.0 AS l_extendedprice, 0.0::DOUBLE AS constant FROM g, s""",
)
def scale_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir, "StandardScaler")


@query(
    "scale_minmax",
    f"""WITH g AS ({_SCALED}), s AS (SELECT min(l_quantity) AS aq, max(l_quantity) AS bq,
                                          min(l_extendedprice) AS ap, max(l_extendedprice) AS bp FROM g)
        SELECT l_orderkey, l_linenumber, round((l_quantity - aq) / (bq - aq), 6) AS l_quantity,
               round((l_extendedprice - ap) / (bp - ap), 6) AS l_extendedprice, 0.0::DOUBLE AS constant FROM g, s""",
)
def scale_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir, "MinMaxScaler")


@query(
    "encode_onehot",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS "o_orderstatus_O",
              CASE WHEN o_orderkey % 7 <> 0 AND o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END::DOUBLE AS "o_orderstatus_P",
              CASE WHEN o_orderpriority = '2-HIGH' THEN 1.0 ELSE 0.0 END::DOUBLE AS "o_orderpriority_2-HIGH",
              CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1.0 ELSE 0.0 END::DOUBLE AS "o_orderpriority_3-MEDIUM",
              CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1.0 ELSE 0.0 END::DOUBLE AS "o_orderpriority_4-NOT SPECIFIED",
              CASE WHEN o_orderpriority = '5-LOW' THEN 1.0 ELSE 0.0 END::DOUBLE AS "o_orderpriority_5-LOW"
       FROM orders""",
)
def encode_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", with_nulls("o_orderstatus", "o_orderkey", 7).alias("o_orderstatus"), "o_orderpriority"
    )
    return encode.one_hot(orders, ["o_orderstatus", "o_orderpriority"])


@query(
    "encode_label",
    """WITH g AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS p_brand, p_name FROM part),
            b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code
                  FROM (SELECT DISTINCT p_brand FROM g WHERE p_brand IS NOT NULL)),
            n AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM g))
       SELECT p_partkey, b.code AS p_brand, n.code AS p_name
       FROM g LEFT JOIN b USING (p_brand) LEFT JOIN n USING (p_name)""",
)
def encode_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        "p_partkey", with_nulls("p_brand", "p_partkey", 7).alias("p_brand"), "p_name"
    )
    return encode.label_encode(part, ["p_brand", "p_name"])


@query(
    "encode_label_ranges",
    """WITH d AS (SELECT text, row_number() OVER (ORDER BY text) - 1 AS code FROM (SELECT DISTINCT text FROM documents))
       SELECT doc_id, d.code AS text FROM documents JOIN d USING (text)""",
)
def encode_label_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label codes by the path for more values than the driver should number."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode.label_encode(documents, ["text"])


# -- outliers -----------------------------------------------------------------

_TWO_SIDED = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN -value ELSE value END AS value FROM events"


def _two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 2 == 0, -F.col("value")).otherwise(F.col("value")).alias("value")
    )


@query(
    "outliers_iqr",
    """WITH g AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events),
            q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM g)
       SELECT event_id, value FROM g, q WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""",
)
def outliers_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", with_nulls("value", "event_id", 7).alias("value"))
    return prepare.remove_outliers(events, "value", prepare.IQR)


@query(
    "outliers_iqr_nearest",
    """WITH g AS (SELECT event_id, value, row_number() OVER (ORDER BY value) - 1 AS rank, count(*) OVER () AS n FROM events),
            q AS (SELECT max(value) FILTER (rank = floor(0.25 * (n - 1) + 0.5)) AS a,
                         max(value) FILTER (rank = floor(0.75 * (n - 1) + 0.5)) AS b FROM g)
       SELECT event_id, value FROM g, q WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""",
)
def outliers_iqr_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return prepare.remove_outliers(events, "value", prepare.IQR, interpolation="nearest")


@query(
    "outliers_zscore",
    f"""WITH g AS ({_TWO_SIDED}), s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM g)
        SELECT event_id, value FROM g, s WHERE abs((value - m) / d) < 3""",
)
def outliers_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.remove_outliers(_two_sided(spark, sf_dir), "value", prepare.Z_SCORE)


@query(
    "outliers_zscore_one_sided",
    f"""WITH g AS ({_TWO_SIDED}), s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM g)
        SELECT event_id, value FROM g, s WHERE (value - m) / d < 3""",
)
def outliers_zscore_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.remove_outliers(_two_sided(spark, sf_dir), "value", prepare.Z_SCORE, ddof=1, one_sided=True)


# -- joins --------------------------------------------------------------------

_KEPT = "SELECT * FROM customer WHERE c_custkey % 3 <> 0"
_EVENTS = "SELECT event_id, user_id AS c_custkey, value FROM events"


def _join(spark: SparkSession, sf_dir: str, how: str, **options: object) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("c_custkey"), "value")
    customer = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0")
    return merge.merge(events, customer, "c_custkey", how, **options)


def _sql_join(how: str) -> str:
    return f"""SELECT event_id, c_custkey, value, c_name, c_nationkey, c_acctbal, c_mktsegment
               FROM ({_EVENTS}) {how} JOIN ({_KEPT}) USING (c_custkey)"""


@query("merge_inner", _sql_join("INNER"))
def merge_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _join(spark, sf_dir, "inner")


@query("merge_left", _sql_join("LEFT"))
def merge_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _join(spark, sf_dir, "left")


@query("merge_right", _sql_join("RIGHT"))
def merge_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _join(spark, sf_dir, "right")


@query("merge_outer", _sql_join("FULL OUTER"))
def merge_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _join(spark, sf_dir, "outer")


def _salted(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    return _join(spark, sf_dir, how, hot_keys=merge.find_hot_keys(events, customer, "c_custkey", bucket_rows=8))


@query("merge_outer_salted", _sql_join("FULL OUTER"))
def merge_outer_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join with the crowded keys of the left side dealt over buckets."""
    return _salted(spark, sf_dir, "outer")


@query("merge_right_salted", _sql_join("RIGHT"))
def merge_right_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The left side of a right join, which run-time splitting leaves alone."""
    return _salted(spark, sf_dir, "right")


@query(
    "merge_equal_rows",
    """SELECT e.kind, e.half, n.n_name, count(*) AS n
       FROM (SELECT CASE event_type WHEN 'error' THEN NULL ELSE event_type END AS kind, user_id % 2 AS half FROM events) e
       FULL JOIN (SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'view' WHEN n_nationkey % 5 = 1 THEN 'none' END AS kind, n_name FROM nation) n
         ON e.kind = n.kind GROUP BY ALL""",
)
def merge_equal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few distinct rows make up the left side: they are collapsed, dealt and copied again."""
    events = table(spark, sf_dir, "events").selectExpr("nullif(event_type, 'error') AS kind", "user_id % 2 AS half")
    nation = table(spark, sf_dir, "nation").selectExpr(
        "CASE WHEN n_nationkey % 5 = 0 THEN 'view' WHEN n_nationkey % 5 = 1 THEN 'none' END AS kind", "n_name"
    )
    joined = merge.merge(events, nation, "kind", "outer", hot_keys=merge.find_hot_keys(events, nation, "kind", bucket_rows=3))
    return joined.select(F.when(F.col("half").isNotNull(), F.col("kind")).alias("kind"), "half", "n_name").groupBy("kind", "half", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "merge_collision",
    """SELECT o.o_custkey AS custkey, o.o_orderkey AS id, o.o_totalprice AS amount, c.c_nationkey AS id_right,
              c.c_acctbal AS amount_right
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
)
def merge_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount")
    )
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("id"), F.col("c_acctbal").alias("amount")
    )
    return merge.merge(orders, customer, "custkey", "inner")


@query(
    "merge_preview",
    f"{_sql_join('LEFT')} ORDER BY event_id LIMIT 1000",
)
def merge_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("c_custkey"), "value")
    customer = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0")
    return merge.merge_preview(events, customer, "c_custkey", "left", 1000, ["event_id"])
