"""CSV ingest on files with the traits of real uploads, sinks and the sample table."""

from __future__ import annotations

import datetime

import pytest

from tabloom.functions.columns import DuplicateColumn
from tabloom.functions.hashing import uniform
from tabloom.ml import split
from tabloom.session import scratch_path
from tabloom.sources import csv, synthetic, tables


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_empty_cells_and_trailing_line(spark, tmp_path):
    path = write(tmp_path, "people.csv", "id,age,name\n1,34,Ann\n2,,\n3,45,Cy\n\n")
    df = csv.read_csv(spark, path)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "bigint", "string"]
    assert [tuple(r) for r in df.collect()] == [(1, 34, "Ann"), (2, None, None), (3, 45, "Cy")]


def test_all_types_and_a_text_null(spark, tmp_path):
    path = write(
        tmp_path,
        "kinds.csv",
        "Integer,Float,String,Boolean,Date,When,Missing\n"
        "1,1.5,a,TRUE,2024-01-31,2024-01-31 10:00:00,None\n2,2e3,Yes,FALSE,2024-02-01,2024-02-01T11:00:00.5,x\n",
    )
    assert csv.infer_types(csv.read_text(spark, path)) == {
        "Integer": "Int64", "Float": "Float64", "String": "String", "Boolean": "Boolean", "Date": "Date",
        "When": "Datetime", "Missing": "String",
    }
    df = csv.read_csv(spark, path, null_values=["None"])
    assert [r["Missing"] for r in df.collect()] == [None, "x"]
    assert df.first()["Date"] == datetime.date(2024, 1, 31)


def test_lookalikes_stay_text(spark):
    df = spark.createDataFrame([("Yes", "1d", "2024", "2024-1-1", None), ("No", "2f", "x", "2024-13-01", None)], "a string, b string, c string, d string, e string")
    assert set(csv.infer_types(df).values()) == {"String"}


def test_question_mark_below_the_inferred_rows(spark, tmp_path):
    path = write(tmp_path, "auto.csv", "hp,name\n" + "".join(f"{i},n{i}\n" for i in range(40)) + "?,last\n")
    assert csv.infer_types(csv.read_text(spark, path), first_rows=None)["hp"] == "String"
    with pytest.raises(Exception):
        csv.read_csv(spark, path, infer_rows=33).collect()
    lenient = csv.read_csv(spark, path, infer_rows=33, ignore_errors=True)
    assert lenient.filter("hp IS NULL").count() == 1
    with_token = csv.read_csv(spark, path, infer_rows=None, null_values=csv.split_tokens("?,NA"))
    assert dict(with_token.dtypes)["hp"] == "bigint" and with_token.filter("hp IS NULL").count() == 1


def test_blank_header(spark, tmp_path):
    path = write(tmp_path, "blank.csv", '"",TV\n1,230.1\n2,44.5\n')
    df = csv.read_csv(spark, path)
    assert df.columns == ["_c0", "TV"] and df.first()["_c0"] == 1


def test_no_tokens_is_no_change(spark):
    df = spark.createDataFrame([("NA", 1)], "t string, n int")
    assert csv.null_tokens(df, csv.split_tokens("")) is df
    assert csv.infer_types(df.select("n")) == {}


def test_cast_report_counts_only_present_cells(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "t string")
    assert tuple(csv.cast_report(df, {"t": "Int8"}).first()) == ("t", "string", "Int8", 1)


def test_folder_of_csv(spark, tmp_path):
    write(tmp_path, "a.csv", "x,y\n1,2\n3,4\n")
    write(tmp_path, "b.csv", "x,y\n5,6\n")
    write(tmp_path, "c.txt", "x,y\n7,8\n")
    found = tables.rows_per_file(tables.csv_folder(spark, str(tmp_path)))
    assert {r["file_name"]: r["rows"] for r in found.collect()} == {"a.csv": 2, "b.csv": 1}


def test_parquet_path_and_round_trip(spark):
    df = spark.createDataFrame([(1, datetime.time(1, 2, 3), datetime.timedelta(days=2))], "x int, t time(6), d interval day to second")
    path = tables.write_parquet(df, scratch_path(spark, "x") + "/data.csv")
    assert path.endswith("/data.parquet")
    assert tables.scan_parquet(spark, path).collect() == df.collect()


def test_limit_reaches_the_scan_in_order(spark, sf_dir):
    rows = tables.scan_parquet(spark, f"{sf_dir}/nation.parquet", limit=3, order_by=["n_nationkey"]).collect()
    assert [r["n_nationkey"] for r in rows] == [0, 1, 2]


def test_sample_table(spark):
    today = datetime.date(2024, 6, 1)
    df = synthetic.sample_table(spark, 3_000, seed=3, today=today)
    again = synthetic.sample_columns(spark.range(0, 3_000, 1, 7).repartition(3), "id", today, seed=3)
    assert sorted(df.collect()) == sorted(again.collect())
    assert sorted(synthetic.sample_table(spark, 50, 4, today).collect()) != sorted(df.limit(50).collect())
    assert df.filter("Float64Column < 0 OR Float64Column >= 100 OR AdditionalColumn1 NOT BETWEEN 1 AND 100").count() == 0
    assert df.filter("DateColumn > DATE'2024-06-01' OR DateColumn < DATE'2023-06-02'").count() == 0
    assert df.filter("AdditionalColumn4 NOT RLIKE '^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$'").count() == 0
    row = df.selectExpr("avg(AdditionalColumn3) m", "stddev(AdditionalColumn3) s", "count(distinct CategoryColumn) c").first()
    assert abs(row["m"] - 50) < 1 and abs(row["s"] - 10) < 1 and row["c"] == 3


def test_split_is_stable_and_disjoint(spark):
    df = spark.range(10_000)
    parts = split.split(df, "id")
    sizes = {n: p.count() for n, p in parts.items()}
    assert sum(sizes.values()) == 10_000 and abs(sizes["train"] - 7_000) < 200
    moved = split.split(df.repartition(13), "id")
    assert {n: p.count() for n, p in moved.items()} == sizes
    assert parts["train"].join(parts["test"], "id").count() == 0
    folds = {r[0] for r in df.select(split.fold("id", 3)).distinct().collect()}
    assert folds == {0, 1, 2} and df.select(uniform(df["id"], 1).alias("u")).filter("u < 0 OR u >= 1").count() == 0


def test_csv_cells_with_quotes_blanks_and_newlines_come_back(spark, tmp_path):
    from tabloom.sources.csv import read_text
    from tabloom.sources.tables import write_csv

    cells = ["  lead", "trail  ", 'say "hi", ok', "two\nlines", "back\\slash", None]
    path = write_csv(spark.createDataFrame([(str(i), c) for i, c in enumerate(cells)], "k string, v string").coalesce(1), f"{tmp_path}/cells")
    assert [r.v for r in read_text(spark, path).orderBy("k").collect()] == cells


def test_folder_of_unlike_headers(spark, tmp_path):
    write(tmp_path, "a.csv", "x,y\n1,2\n3,4\n")
    write(tmp_path, "b.csv", "y,x,z\n5,6,7\n")
    write(tmp_path, "c.csv", '\ufeffy,"a, b",\n"",8,9\n')
    write(tmp_path, "d,[1] %20.csv", "z\n10\n")
    write(tmp_path, "empty.csv", "")
    write(tmp_path, "only.csv", "q,x\n")
    df = tables.csv_folder(spark, str(tmp_path))
    assert df.columns == ["x", "y", "z", "a, b", "_c2", "q", "file_name"]
    none = (None,) * 3
    assert sorted(map(tuple, df.collect()), key=str) == sorted(
        [("1", "2", None, *none, "a.csv"), ("3", "4", None, *none, "a.csv"), ("6", "5", "7", *none, "b.csv"), (None, "", None, "8", "9", None, "c.csv"), (None, None, "10", *none, "d,[1] %20.csv")], key=str
    )
    counts = {r["file_name"]: r["rows"] for r in tables.rows_per_file(df).collect()}
    assert counts == {"a.csv": 2, "b.csv": 1, "c.csv": 1, "d,[1] %20.csv": 1}


def test_folder_headers_of_files_in_several_blocks(spark, tmp_path):
    for name, header in (("a.csv", "k,v"), ("b.csv", "v,k")):
        write(tmp_path, name, header + "\n" + "".join(f"{i},{i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        found = {r["file_path"].rsplit("/", 1)[1]: r["header"] for r in tables.header_catalogue(spark, str(tmp_path)).collect()}
        assert found == {"a.csv": "k,v", "b.csv": "v,k"}
        df = tables.csv_folder(spark, str(tmp_path), multi_line=False)
        assert df.filter("k = v").count() == 40_000 and df.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_folder_headers_are_found_without_a_sort(spark, tmp_path):
    for i in range(30):
        write(tmp_path, f"f{i}.csv", f"k,v{i % 2}\n" + "k,v\n" * (i % 3))
    catalogue = tables.header_catalogue(spark, str(tmp_path))
    plan = catalogue._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
    found = {r["file_path"].rsplit("/", 1)[1]: r["header"] for r in catalogue.collect()}
    assert found == {f"f{i}.csv": f"k,v{i % 2}" for i in range(30)} and catalogue.count() == 30


def test_first_lines_of_files_in_several_batches():
    import pyarrow as pa

    batches = [pa.record_batch({"file_path": list(p), "header": list(h)}) for p, h in (("aab", "123"), ("", ""), ("b", "4"), ("bcc", "567"), ("de", "89"))]
    batches[1] = batches[0].slice(0, 0)
    got = [r for b in tables._first_lines(batches) for r in b.to_pylist()]
    assert [(r["file_path"], r["header"]) for r in got] == [("a", "1"), ("b", "3"), ("c", "6"), ("d", "8"), ("e", "9")]


def test_folder_guards(spark, tmp_path):
    write(tmp_path, "a.csv", "x,X,file_name\n1,2,3\n")
    with pytest.raises(DuplicateColumn):
        tables.csv_folder(spark, str(tmp_path))
    df = tables.csv_folder(spark, str(tmp_path), file_column="source")
    assert df.columns == ["x0", "X1", "file_name", "source"] and tuple(df.first()) == ("1", "2", "3", "a.csv")


def test_empty_text_and_null_come_back(spark, tmp_path):
    rows = [(1, "", None, ""), (2, None, "", "x"), (3, '""', " ", 'a"b\n,c'), (4, "\\", "\t", None)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string, c string")
    tables.write_csv(df, f"{tmp_path}/out")
    assert sorted(map(tuple, csv.read_csv(spark, f"{tmp_path}/out").collect())) == rows


def test_quoted_empty_cells_of_a_number_column_are_null(spark, tmp_path):
    path = write(tmp_path, "quoted.csv", '"id","n","t"\n"1","","x"\n"2","5",""\n')
    df = csv.read_csv(spark, path)
    assert [tuple(r) for r in df.collect()] == [(1, None, "x"), (2, 5, "")]


def test_one_line_rows_need_no_multi_line(spark, tmp_path):
    path = write(tmp_path, "lines.csv", "id,t\n" + "".join(f"{i},t{i}\n" for i in range(50_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        split, whole = (csv.read_csv(spark, path, multi_line=m) for m in (False, True))
        assert split.rdd.getNumPartitions() > 4 and whole.rdd.getNumPartitions() == 1
        assert split.exceptAll(whole).isEmpty() and split.count() == 50_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
