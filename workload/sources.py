"""Reading, writing, typing and generating tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F


from tabloom.operators.project import change_type, select_and_cast
from tabloom.session import scratch_path
from tabloom.sources import csv, synthetic, tables
from workload.registry import query, rounded, table


@query("scan_parquet", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_parquet(spark, f"{sf_dir}/customer.parquet")


@query("head_limit", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def head_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_parquet(
        spark, f"{sf_dir}/orders.parquet", limit=1000, order_by=[F.desc("o_totalprice"), "o_orderkey"]
    )


def _as_csv(spark: SparkSession, df: DataFrame, name: str) -> str:
    return tables.write_csv(df, scratch_path(spark, name))


@query(
    "csv_scan",
    "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders",
)
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        "o_totalprice",
        F.col("o_orderdate").cast("date").alias("o_orderdate"),
        "o_orderpriority",
    )
    return csv.read_csv(spark, _as_csv(spark, orders, "orders"), infer_rows=None)


_INFER = """
SELECT '{c}' AS column_name,
       CASE WHEN count(*) = count_if(lower(x) IN ('true', 'false')) THEN 'Boolean'
            WHEN count(*) = count_if(regexp_full_match(x, '[-+]?\\d+')) THEN 'Int64'
            WHEN count(*) = count(TRY_CAST(x AS DOUBLE)) THEN 'Float64'
            WHEN count(*) = count_if(regexp_full_match(x, '\\d{{4}}-\\d{{2}}-\\d{{2}}')) THEN 'Date'
            WHEN count(*) = count(TRY_CAST(x AS TIMESTAMP)) THEN 'Datetime'
            ELSE 'String' END AS inferred
FROM (SELECT CAST({e} AS VARCHAR) AS x FROM events)
"""


@query(
    "csv_infer_schema",
    " UNION ALL ".join(
        _INFER.format(c=c, e=e)
        for c, e in {
            "event_id": "event_id",
            "ts": "ts",
            "day": "CAST(ts AS DATE)",
            "value": "value",
            "failed": "event_type = 'error'",
            "event_type": "event_type",
        }.items()
    ),
)
def csv_infer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("string").alias("ts"),
        F.col("ts").cast("date").alias("day"),
        "value",
        (F.col("event_type") == "error").alias("failed"),
        "event_type",
    )
    text = csv.read_text(spark, _as_csv(spark, events, "events"))
    found = csv.infer_types(text, first_rows=None)
    return spark.createDataFrame(list(found.items()), "column_name string, inferred string")


@query(
    "null_tokens",
    """SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('P', 'NA') THEN o_orderstatus END AS o_orderstatus,
              CASE WHEN o_orderpriority NOT IN ('P', 'NA', '5-LOW') THEN o_orderpriority END AS o_orderpriority
       FROM orders""",
)
def null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return csv.null_tokens(orders, csv.split_tokens("P,NA,5-LOW"))


_TOKENS = "CASE WHEN o_orderkey % 5 = 0 THEN '?' WHEN o_orderkey % 7 = 0 THEN 'NA' ELSE CAST(o_orderkey AS STRING) END"


@query(
    "lenient_cast",
    f"SELECT o_orderkey, TRY_CAST({_TOKENS} AS BIGINT) AS number FROM orders",
)
def lenient_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TOKENS).alias("number"))
    return change_type(text, "number", "Int64", lenient=True)


@query(
    "cast_report",
    f"""SELECT 'o_orderkey' AS column_name, 'bigint' AS from_type, 'UInt16' AS to_type,
               count(*) FILTER (o_orderkey > 65535 OR o_orderkey < 0) AS uncastable FROM orders
        UNION ALL SELECT 'token', 'string', 'Int64', count(*) FILTER (TRY_CAST({_TOKENS} AS BIGINT) IS NULL) FROM orders
        UNION ALL SELECT 'o_orderstatus', 'string', 'Float64', count(*) FROM orders
        UNION ALL SELECT 'o_totalprice', 'double', 'Int8', count(*) FILTER (trunc(o_totalprice) > 127) FROM orders""",
)
def cast_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("token", F.expr(_TOKENS))
    return csv.cast_report(
        orders, {"o_orderkey": "UInt16", "token": "Int64", "o_orderstatus": "Float64", "o_totalprice": "Int8"}
    )


@query(
    "select_and_cast",
    """SELECT CAST(trunc(l_quantity) AS INTEGER) AS l_quantity, CAST(l_orderkey AS VARCHAR) AS l_orderkey,
              CAST(l_shipdate AS DATE) AS l_shipdate, l_returnflag FROM lineitem""",
)
def select_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_and_cast(
        table(spark, sf_dir, "lineitem"),
        {"l_quantity": "Int32", "l_orderkey": "String", "l_shipdate": "Date", "l_returnflag": None},
    )


@query("parquet_roundtrip", "SELECT * FROM orders")
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.write_parquet(table(spark, sf_dir, "orders"), scratch_path(spark, "orders") + ".csv")
    return tables.scan_parquet(spark, path)


@query("csv_roundtrip", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    path = tables.write_csv(part, scratch_path(spark, "part"))
    return spark.read.csv(path, header=True, schema=part.schema, mode="FAILFAST").select(*part.columns)


@query("csv_folder", "SELECT count(*) AS rows, true AS all_csv FROM lineitem")
def csv_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    files = 4 * max(1, lineitem.rdd.getNumPartitions())  # a file is read by one task, so there are more as the table grows
    folder = tables.write_csv(lineitem.repartition(files, "l_orderkey", "l_linenumber"), scratch_path(spark, "lineitem"))
    per_file = tables.rows_per_file(tables.csv_folder(spark, folder))
    return per_file.agg(
        F.sum("rows").alias("rows"), F.bool_and(F.col("file_name").endswith(".csv")).alias("all_csv")
    )


@query(
    "csv_folder_headers",
    """SELECT part, count(*) AS rows, count(l_tax) AS taxed, round(sum(l_quantity), 2) AS quantity, round(sum(l_tax), 2) AS tax
       FROM (SELECT l_linenumber % 3 AS part, l_quantity, CASE WHEN l_linenumber % 3 = 1 THEN l_tax END AS l_tax FROM lineitem) GROUP BY part""",
)
def csv_folder_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of three headers: the same columns in another order, and one with a column more."""
    lineitem = table(spark, sf_dir, "lineitem").withColumn("part", F.col("l_linenumber") % 3)
    folder = scratch_path(spark, "headers")
    for part, names in enumerate((["l_quantity", "part"], ["part", "l_tax", "l_quantity"], ["part", "l_quantity"])):
        tables.write_csv(lineitem.filter(F.col("part") == part).select(*names), f"{folder}/part={part}/files")
    found = tables.csv_folder(spark, f"{folder}/part=*/files")
    per_part = found.groupBy(F.col("part").cast("long").alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("l_tax").alias("taxed"), F.sum(F.col("l_quantity").cast("double")).alias("quantity"),
        F.sum(F.col("l_tax").cast("double")).alias("tax"),
    )
    return rounded(per_part, 2, "quantity", "tax")


_ODD_CELLS = """CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'a "quoted" cell' WHEN 3 THEN 'two' || chr(10) || 'lines'
                WHEN 4 THEN '  blanks, and a comma ' WHEN 5 THEN '""' ELSE o_orderpriority END"""


@query("csv_rfc", f"SELECT o_orderkey, {_ODD_CELLS} AS cell, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS price FROM orders")
def csv_rfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty texts, nulls, quotes, line breaks and blanks come back from a file as they were."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_ODD_CELLS} AS cell", "CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS price")
    return csv.read_csv(spark, _as_csv(spark, orders, "rfc"), infer_rows=None)


@query("csv_split_files", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS status FROM orders")
def csv_split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose rows are lines are split among tasks."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS status")
    return csv.read_csv(spark, _as_csv(spark, orders, "split"), infer_rows=None, multi_line=False)


def _md5_number(seed: str) -> str:
    return f"CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|1:{seed}'), 1, 8) AS BIGINT)"


_U, _V, _T = (f"({_md5_number(s)})" for s in ("normal u", "normal v", "time"))


@query(
    "synthetic_table",
    f"""SELECT 'String_' || o_orderkey AS "StringColumn",
       round({_md5_number('float')} / 4294967296.0 * 100.0, 6) AS "Float64Column",
       'Category_' || (['A', 'B', 'C'])[{_md5_number('category')} % 3 + 1] AS "CategoryColumn",
       CAST(DATE '2024-12-31' - CAST({_md5_number('date')} % 366 AS INTEGER) AS DATE) AS "DateColumn",
       {_md5_number('boolean')} % 2 = 0 AS "BooleanColumn",
       CAST({_md5_number('int')} % 100 + 1 AS INTEGER) AS "AdditionalColumn1",
       'Extra_' || o_orderkey AS "AdditionalColumn2",
       round(50.0 + 10.0 * sqrt(-2.0 * ln(1.0 - {_U} / 4294967296.0)) * cos(2.0 * pi() * ({_V} / 4294967296.0)), 6)
           AS "AdditionalColumn3",
       lpad(CAST({_T} % 86400 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST({_T} % 86400 // 60 % 60 AS VARCHAR), 2, '0')
           || ':' || lpad(CAST({_T} % 86400 % 60 AS VARCHAR), 2, '0') AS "AdditionalColumn4",
       (['X', 'Y', 'Z'])[{_md5_number('letter')} % 3 + 1] AS "AdditionalColumn5"
FROM orders""",
)
def synthetic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = synthetic.sample_columns(table(spark, sf_dir, "orders"), "o_orderkey", datetime.date(2024, 12, 31), seed=1)
    return rounded(made, 6, "Float64Column", "AdditionalColumn3")
