"""Reading and writing tables."""

from __future__ import annotations

import csv as csv_lines
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabloom.functions.columns import DuplicateColumn, col
from tabloom.operators.project import head
from tabloom.sources import csv


def scan_parquet(
    spark: SparkSession, path: str, limit: int | None = None, order_by: list[str | Column] | None = None
) -> DataFrame:
    """A parquet table; a row limit is opt-in and applies in the given order."""
    return head(spark.read.parquet(path), limit, order_by)


def parquet_path(csv_path: str) -> str:
    """Where the parquet form of an uploaded CSV goes."""
    return csv_path[: -len(".csv")] + ".parquet" if csv_path.endswith(".csv") else csv_path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    target = parquet_path(path)
    df.write.mode(mode).parquet(target)
    return target


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One CSV file a partition; blanks at cell ends stay, quotes inside a cell are doubled, null is an
    empty cell and empty text a quoted one. (A null in a table of a single column is a blank line,
    which readers skip.)"""
    df.write.mode(mode).csv(
        path, header=True, escape='"', nullValue="", emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return path


def _first_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run of rows of one file."""
    last = None
    for batch in batches:
        if batch.num_rows:
            runs = pc.run_end_encode(batch.column("file_path"))
            starts = [0, *runs.run_ends.to_pylist()[:-1]]
            yield batch.take(pa.array(starts[runs.values[0].as_py() == last :], pa.int64()))
            last = runs.values[-1].as_py()


def header_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """``(file_path, header)``: the first line of each CSV file below a folder; files without a line have none.

    A file's first line is that of its first block, which one task reads in order; the lines pass it as a
    stream and only the first is kept, so nothing is sorted or held."""
    lines = spark.read.text(folder, pathGlobFilter="*.csv").filter("_metadata.file_block_start = 0")
    rows = lines.select("_metadata.file_path", F.col("value").alias("header"))
    return rows.mapInArrow(_first_lines, rows.schema)


def column_names(header: str) -> list[str]:
    """The names of a header line; a blank one becomes ``_c<position>``, a repeated one gets its position."""
    names = next(csv_lines.reader([header.removeprefix("\ufeff")], strict=True))
    known = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if known.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _plain_path(uri: str) -> str:
    """A path as readers take it: without escapes of the URI, with those that keep names from being patterns."""
    return re.sub(r"([\\*?{}\[\],])", r"\\\1", unquote(uri))


def csv_folder(spark: SparkSession, folder: str, multi_line: bool = True, file_column: str = "file_name") -> DataFrame:
    """All CSV files below a folder as one text table by column names, with the file's name per row.

    Files are grouped by their header and each group is read with it, so columns may come in any order
    and files may lack some, which are null then. Columns are ordered as the headers, taken by their
    first file, bring them up. A header is one line."""
    groups: dict[str, list[str]] = {}
    for row in header_catalogue(spark, folder).orderBy("file_path").collect():
        groups.setdefault(row["header"], []).append(row["file_path"])
    parts = []
    for header, files in groups.items():
        names = column_names(header)
        if file_column in names:
            raise DuplicateColumn(f"the files have a column '{file_column}'; choose another file_column")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        read = spark.read.schema(schema).csv([_plain_path(f) for f in files], **csv.text_options(multi_line))
        # the reader gives names as in a URI, where a plus stands for itself
        name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
        parts.append(csv.empties_back(read.select("*", name.alias(file_column))))
    if not parts:
        return spark.createDataFrame([], f"{file_column} string")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*[col(c) for c in out.columns if c != file_column], col(file_column))


def rows_per_file(table: DataFrame) -> DataFrame:
    return table.groupBy("file_name").agg(F.count(F.lit(1)).alias("rows"))
