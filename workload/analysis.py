"""Profiles and the data behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.operators import explore, profile
from workload.registry import query, rounded, sql_nulls, table, with_nulls

# -- profiles -----------------------------------------------------------------

_REPEATED = f"""SELECT event_id, ts, user_id, event_type, {sql_nulls('value', 'event_id', 7)} AS value, props FROM events
                UNION ALL SELECT event_id, ts, user_id, event_type, {sql_nulls('value', 'event_id', 7)}, props
                FROM events WHERE event_id % 10 = 0"""


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("value", with_nulls("value", "event_id", 7))
    return events.unionByName(events.filter("event_id % 10 = 0"))


_SQL_DUPLICATES = "(SELECT count(*) AS n FROM r GROUP BY event_id, ts, user_id, event_type, value, props HAVING count(*) > 1)"


@query(
    "dataset_summary",
    f"""WITH r AS ({_REPEATED})
        SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM r
        UNION ALL SELECT 'columns', 6.0::DOUBLE
        UNION ALL SELECT 'missing_values', count_if(value IS NULL)::DOUBLE FROM r
        UNION ALL SELECT 'size_mb', round((sum(24 + strlen(event_type) + strlen(props)) + 8 * count(value)) / 1048576.0, 2)::DOUBLE FROM r
        UNION ALL SELECT 'duplicate_rows', floor(coalesce(sum(n), 0) / 2)::DOUBLE FROM {_SQL_DUPLICATES}""",
)
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dataset_summary(_repeated(spark, sf_dir))


@query(
    "duplicate_rows",
    f"""WITH r AS ({_REPEATED})
        SELECT floor(coalesce(sum(n), 0) / 2)::BIGINT AS duplicate_rows, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows
        FROM {_SQL_DUPLICATES}""",
)
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_rows(_repeated(spark, sf_dir))


@query(
    "logical_size",
    """SELECT sum(16 + strlen(text) + strlen(lang) + strlen(source))::BIGINT AS size_bytes,
              round(sum(16 + strlen(text) + strlen(lang) + strlen(source)) / 1048576.0, 2)::DOUBLE AS size_mb FROM documents""",
)
def logical_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.logical_size(table(spark, sf_dir, "documents"))


_DESCRIBED = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]
_DESCRIBED_TEXT = ["l_returnflag", "l_linestatus"]
_SOURCE = f"""SELECT l_orderkey, l_linenumber, {sql_nulls('l_quantity', 'l_orderkey', 7)} AS l_quantity, l_extendedprice,
                     l_discount, {sql_nulls('l_returnflag', 'l_suppkey', 4)} AS l_returnflag, l_linestatus FROM lineitem"""


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        with_nulls("l_quantity", "l_orderkey", 7).alias("l_quantity"),
        "l_extendedprice",
        "l_discount",
        with_nulls("l_returnflag", "l_suppkey", 4).alias("l_returnflag"),
        "l_linestatus",
    )


def _sql_describe(columns: list[str], texts: list[str]) -> str:
    numbers = {
        "count": "count({c})", "null_count": "count(*) - count({c})", "mean": "avg({c})", "std": "stddev_samp({c})",
        "min": "min({c})", "25%": "quantile_cont({c}, 0.25)", "50%": "quantile_cont({c}, 0.5)",
        "75%": "quantile_cont({c}, 0.75)", "max": "max({c})",
    }
    rows = [
        f"SELECT '{c}' AS column_name, '{s}' AS statistic, round(CAST({e.format(c=c)} AS DOUBLE), 4) AS value, NULL::VARCHAR AS text FROM d"
        for c in columns
        for s, e in numbers.items()
    ]
    rows += [
        f"SELECT '{c}', '{s}', CAST({numbers[s].format(c=c)} AS DOUBLE), NULL::VARCHAR FROM d"
        for c in texts
        for s in ("count", "null_count")
    ]
    rows += [f"SELECT '{c}', '{s}', NULL, {s}({c}) FROM d" for c in texts for s in ("min", "max")]
    return f"WITH d AS ({_SOURCE}) " + " UNION ALL ".join(rows)


@query("describe", _sql_describe(_DESCRIBED, _DESCRIBED_TEXT))
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.describe(_described(spark, sf_dir)), 4, "value")


_OVERVIEW = {
    "count": "count({c})", "null_count": "count(*) - count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})",
    "25%": "quantile_cont({c}, 0.25)", "50%": "quantile_cont({c}, 0.5)", "75%": "quantile_cont({c}, 0.75)", "max": "max({c})",
}
_OVERVIEW_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


@query(
    "model_overview",
    f"""WITH d AS (SELECT o_orderkey, o_custkey, {sql_nulls('o_totalprice', 'o_orderkey', 7)} AS o_totalprice, o_orderstatus FROM orders),
             h AS (SELECT * FROM d ORDER BY o_orderkey LIMIT 5)
        SELECT 'summary' AS part, '' AS column_name, 'rows' AS name, count(*)::DOUBLE AS value FROM d
        UNION ALL SELECT 'summary', '', 'columns', 4 UNION ALL SELECT 'summary', '', 'missing_values', count(*) - count(o_totalprice) FROM d
        UNION ALL SELECT 'summary', '', 'duplicate_rows', 0
        UNION ALL SELECT 'head', 'o_orderkey', CAST(o_orderkey AS VARCHAR), o_custkey FROM h """
    + "".join(
        f" UNION ALL SELECT 'statistics', '{c}', '{s}', round(CAST({e.format(c=c)} AS DOUBLE), 4) FROM d" for c in _OVERVIEW_NUMBERS for s, e in _OVERVIEW.items()
    ),
)
def model_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is looked at before a model is chosen: first rows, summary and statistics of the numbers."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", with_nulls("o_totalprice", "o_orderkey", 7).alias("o_totalprice"), "o_orderstatus"
    )
    parts = profile.overview(orders, order_by=["o_orderkey"])
    kind = lambda name: F.lit(name).alias("part")
    summary = parts["summary"].filter("metric <> 'size_mb'").select(kind("summary"), F.lit("").alias("column_name"), F.col("metric").alias("name"), "value")
    first = parts["head"].select(kind("head"), F.lit("o_orderkey").alias("column_name"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_custkey").cast("double").alias("value"))
    numbers = parts["statistics"].filter(F.col("column_name").isin(_OVERVIEW_NUMBERS))
    statistics = numbers.select(kind("statistics"), "column_name", F.col("statistic").alias("name"), F.round("value", 4).alias("value"))
    return summary.unionByName(first).unionByName(statistics)


def _sql_summary(column: str, data_type: str, numeric: bool, source: str = "d") -> str:
    head = f"""'{column}' AS column_name, '{data_type}' AS data_type,
        (count(DISTINCT {column}) + max(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END))::BIGINT AS unique_values,
        count(*) - count({column}) AS missing_values"""
    if not numeric:
        empty = ", ".join(f"NULL::DOUBLE AS {m}" for m in ("mean", "median", "mode", "std", "min", "max"))
        return f"SELECT {head}, {empty} FROM {source}"
    return f"""SELECT {head}, round(avg({column}), 4) AS mean, round(median({column})::DOUBLE, 4) AS median,
        round((SELECT {column} FROM {source} WHERE {column} IS NOT NULL
               GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)::DOUBLE, 4) AS mode,
        round(stddev_samp({column}), 4) AS std, round(min({column})::DOUBLE, 4) AS min,
        round(max({column})::DOUBLE, 4) AS max FROM {source}"""


_NUMBERS = ("mean", "median", "mode", "std", "min", "max")


@query(
    "column_summary",
    f"WITH d AS ({_SOURCE}) "
    + " UNION ALL ".join(
        _sql_summary(c, t, True)
        for c, t in {"l_quantity": "double", "l_extendedprice": "double", "l_linenumber": "int", "l_orderkey": "bigint"}.items()
    ),
)
def column_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_linenumber", "l_orderkey"]
    return rounded(profile.column_summary(_described(spark, sf_dir), columns), 4, *_NUMBERS)


@query(
    "column_summary_text",
    "WITH d AS (SELECT *, CASE WHEN doc_id % 7 <> 0 THEN lang END AS maybe_lang FROM documents) "
    + " UNION ALL ".join(_sql_summary(c, "string", False) for c in ("text", "source", "maybe_lang")),
)
def column_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("maybe_lang", with_nulls("lang", "doc_id", 7))
    return profile.column_summary(documents, ["text", "source", "maybe_lang"])


_MAYBE_TYPE = f"SELECT {sql_nulls('event_type', 'event_id', 7)} AS event_type, user_id, value FROM events"


def _maybe_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        with_nulls("event_type", "event_id", 7).alias("event_type"), "user_id", "value"
    )


@query("value_counts", f"SELECT event_type, count(*) AS count FROM ({_MAYBE_TYPE}) GROUP BY event_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(_maybe_type(spark, sf_dir), "event_type")


# -- one column ---------------------------------------------------------------

_PRICES = "SELECT CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS x FROM lineitem"
_HISTOGRAM = f"""WITH v AS (SELECT x FROM ({_PRICES}) WHERE x IS NOT NULL),
    e AS (SELECT min(x) AS a, (max(x) - min(x)) / 30 AS w FROM v),
    b AS (SELECT least(floor((x - a) / w), 29)::INTEGER AS bin, count(*) AS n FROM v, e GROUP BY 1),
    h AS (SELECT i::INTEGER AS bin, a + i * w AS lower, a + (i + 1) * w AS upper, coalesce(n, 0) AS count
          FROM range(30) g(i) CROSS JOIN e LEFT JOIN b ON b.bin = g.i)"""


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(with_nulls("l_extendedprice", "l_orderkey", 7).alias("x"))


@query("histogram", f"{_HISTOGRAM} SELECT bin, round(lower, 4) AS lower, round(upper, 4) AS upper, count FROM h")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explore.histogram(_prices(spark, sf_dir), "x"), 4, "lower", "upper")


@query(
    "density",
    f"""{_HISTOGRAM} SELECT bin, round(lower, 4) AS lower, round(upper, 4) AS upper,
        round(count / ((SELECT count(*) FROM v) * (upper - lower)), 10) AS density FROM h""",
)
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(explore.density(_prices(spark, sf_dir), "x"), 4, "lower", "upper"), 10, "density")


@query(
    "density_2d",
    """WITH e AS (SELECT min(l_quantity) AS a, (max(l_quantity) - min(l_quantity)) / 30 AS w,
                         min(l_extendedprice) AS b, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS h, count(*) AS n FROM lineitem)
       SELECT least(floor((l_quantity - a) / w), 29)::INTEGER AS x_bin, least(floor((l_extendedprice - b) / h), 29)::INTEGER AS y_bin,
              count(*) AS count, round(count(*) / max(n * w * h), 10) AS density
       FROM lineitem, e GROUP BY 1, 2""",
)
def density_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explore.density_2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), 10, "density")


_SQL_BOX = """q AS (SELECT quantile_cont(value, 0.25) AS q1, median(value) AS m, quantile_cont(value, 0.75) AS q3 FROM s),
    b AS (SELECT value, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM s, q WHERE value IS NOT NULL)"""


@query(
    "box_stats",
    f"""WITH s AS (SELECT {sql_nulls('value', 'event_id', 7)} AS value FROM events), {_SQL_BOX}
        SELECT round(any_value(q1), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(q3), 4) AS q3,
               min(value) FILTER (inside) AS whisker_low, max(value) FILTER (inside) AS whisker_high,
               count(*) FILTER (NOT inside) AS outliers FROM b, q""",
)
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(with_nulls("value", "event_id", 7).alias("value"))
    return rounded(explore.box_stats(events, "value"), 4, "q1", "median", "q3")


@query(
    "univariate_numeric",
    f"""WITH s AS (SELECT value FROM events), {_SQL_BOX},
        e AS (SELECT min(value) AS a, (max(value) - min(value)) / 30 AS w FROM s)
        SELECT 'mean' AS item, round(avg(value), 4) AS value FROM s
        UNION ALL SELECT 'std', round(stddev_samp(value), 4) FROM s
        UNION ALL SELECT 'median', round(median(value), 4) FROM s
        UNION ALL SELECT 'unique_values', count(DISTINCT value)::DOUBLE FROM s
        UNION ALL SELECT 'outliers', count_if(NOT inside)::DOUBLE FROM b
        UNION ALL SELECT 'bin ' || least(floor((value - a) / w), 29)::INTEGER, count(*)::DOUBLE FROM s, e GROUP BY 1""",
)
def univariate_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = explore.univariate(table(spark, sf_dir, "events").select("value"), "value")
    summary = parts["summary"].select(
        "mean", "std", "median", F.col("unique_values").cast("double").alias("unique_values")
    )
    items = summary.unpivot([], summary.columns, "item", "value")
    outliers = parts["box"].select(F.lit("outliers").alias("item"), F.col("outliers").cast("double").alias("value"))
    bins = parts["histogram"].filter("count > 0").select(
        F.concat(F.lit("bin "), "bin").alias("item"), F.col("count").cast("double").alias("value")
    )
    return rounded(items.unionByName(outliers).unionByName(bins), 4, "value")


@query(
    "univariate_categorical",
    f"""WITH s AS ({_MAYBE_TYPE})
        SELECT 'unique_values' AS item, (count(DISTINCT event_type) + 1)::BIGINT AS value FROM s
        UNION ALL SELECT 'missing_values', count(*) - count(event_type) FROM s
        UNION ALL SELECT 'count ' || coalesce(event_type, 'null'), count(*) FROM s GROUP BY event_type""",
)
def univariate_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = explore.univariate(_maybe_type(spark, sf_dir), "event_type")
    items = parts["summary"].unpivot([], ["unique_values", "missing_values"], "item", "value")
    counts = parts["value_counts"].select(
        F.concat(F.lit("count "), F.coalesce("event_type", F.lit("null"))).alias("item"), F.col("count").alias("value")
    )
    return items.unionByName(counts)


# -- two and more columns -----------------------------------------------------

@query(
    "correlation_pair",
    f"SELECT round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS corr FROM ({_SOURCE})",
)
def correlation_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explore.correlation_pair(_described(spark, sf_dir), "l_quantity", "l_extendedprice"), 6, "corr")


def _sql_matrix(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM ({source})"
        for a in columns
        for b in columns
    )


@query("correlation_matrix", _sql_matrix(["l_quantity", "l_extendedprice", "l_discount"], _SOURCE))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = ["l_quantity", "l_extendedprice", "l_discount"]
    return rounded(explore.correlation_matrix(_described(spark, sf_dir), chosen), 6, "corr")


_LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


@query("correlation_numeric", _sql_matrix(_LINEITEM_NUMBERS, "SELECT * FROM lineitem"))
def correlation_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explore.correlation_numeric(table(spark, sf_dir, "lineitem")), 6, "corr")


_WIDE = {
    f"w{i:02d}": f"CASE WHEN (l_orderkey + {i}) % {i % 5 + 2} <> 0 THEN {_LINEITEM_NUMBERS[i % 8]} * {i + 1} + {_LINEITEM_NUMBERS[(i * 3 + 1) % 8]} END"
    for i in range(24)
}
_WIDE_COLUMNS = ", ".join(f"{e} AS {n}" for n, e in _WIDE.items())
_WIDE_PAIRS = ", ".join(f"round(corr({a}, {b}), 6) + 0.0 AS {a}_{b}" for a in _WIDE for b in _WIDE)


@query(
    "correlation_wide",
    f"""SELECT split_part(pair, '_', 1) AS col_a, split_part(pair, '_', 2) AS col_b, corr
        FROM (SELECT {_WIDE_PAIRS} FROM (SELECT {_WIDE_COLUMNS} FROM lineitem)) UNPIVOT INCLUDE NULLS (corr FOR pair IN (COLUMNS(*)))""",
)
def correlation_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 columns, all with gaps of their own: every pair is taken over its own complete rows."""
    wide = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _WIDE.items()])
    return rounded(explore.correlation_numeric(wide), 6, "corr")


@query("bar_totals", f"SELECT event_type, round(sum(value), 2) AS total FROM ({_MAYBE_TYPE}) GROUP BY event_type")
def bar_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explore.bar_totals(_maybe_type(spark, sf_dir), "event_type", "value"), 2, "total")


@query("scatter_points", "SELECT l_quantity, l_extendedprice, l_discount FROM lineitem")
def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.scatter_points(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    "bivariate_numeric",
    "SELECT p_size, p_retailprice, round((SELECT corr(p_size, p_retailprice) FROM part), 6) + 0.0 AS corr FROM part",
)
def bivariate_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = explore.bivariate(table(spark, sf_dir, "part"), "p_size", "p_retailprice")
    return parts["points"].withColumn("corr", F.round(F.lit(parts["correlation"].first()["corr"]), 6))


@query("bivariate_categorical", "SELECT p_brand, round(sum(p_retailprice), 2) AS total FROM part GROUP BY p_brand")
def bivariate_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = explore.bivariate(table(spark, sf_dir, "part"), "p_brand", "p_retailprice")
    return rounded(parts["bars"], 2, "total")


@query("cross_tab", "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL")
def cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.cross_tab(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    "cross_tab_wide",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
              count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority""",
)
def cross_tab_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.cross_tab_wide(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])
