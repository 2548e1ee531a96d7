"""CSV ingest: text scan, null tokens, type inference, chosen casts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabloom.functions.columns import col, replace_columns, require_columns
from tabloom.functions.types import TYPES, cast_column
from tabloom.operators.project import select_and_cast

DEFAULT_INFER_ROWS = 1_000

# What text must look like to be a candidate for each type, in
# the order the types are tried. Spark's casts alone accept more ("yes" as a
# boolean, "1d" as a double, "2020" as a date).
LOOKS_LIKE = {
    "Boolean": r"(?i)^\s*(true|false)\s*$",
    "Int64": r"^\s*[-+]?\d+\s*$",
    "Float64": r"(?i)^\s*[-+]?((\d+\.?\d*|\.\d+)(e[-+]?\d+)?|nan|inf|infinity)\s*$",
    "Date": r"^\s*\d{4}-\d{2}-\d{2}\s*$",
    "Datetime": r"^\s*\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*$",
}


#: What a quoted empty cell reads as until it becomes empty text; an unquoted one is null.
QUOTED_EMPTY = "\ue000tabloom quoted empty\ue000"


def text_options(multi_line: bool) -> dict[str, object]:
    return {"header": True, "escape": '"', "multiLine": multi_line, "nullValue": "", "emptyValue": QUOTED_EMPTY}


def empties_back(df: DataFrame) -> DataFrame:
    """Empty text where a quoted empty cell was read, ``_c<position>`` where it was a header."""
    df = df.toDF(*[f"_c{i}" if c.startswith(QUOTED_EMPTY) else c for i, c in enumerate(df.columns)])
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return replace_columns(df, {c: F.when(col(c) == QUOTED_EMPTY, "").otherwise(col(c)) for c in texts})


def read_text(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Every column as text; a blank header becomes ``_c<position>``, an unquoted empty cell is null
    and a quoted one empty text.

    Without ``multi_line`` a line break ends a row even inside quotes; then large files are split
    among tasks, while with it a file is read by one task.
    """
    return empties_back(spark.read.csv(path, inferSchema=False, **text_options(multi_line)))


def split_tokens(text: str) -> list[str]:
    """Null tokens from comma-separated text."""
    return text.split(",") if text else []


def null_tokens(df: DataFrame, tokens: Iterable[str]) -> DataFrame:
    """Null for every text cell that equals one of the tokens."""
    tokens = list(tokens)
    if not tokens:
        return df
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return replace_columns(df, {c: F.when(~col(c).isin(tokens), col(c)) for c in texts})


def _fits(name: str, type_name: str) -> Column:
    text = col(name)
    return text.rlike(LOOKS_LIKE[type_name]) & text.try_cast(TYPES[type_name].spark).isNotNull()


def infer_types(df: DataFrame, first_rows: int | None = DEFAULT_INFER_ROWS) -> dict[str, str]:
    """The narrowest type that fits every text cell of the first rows (None: all rows).

    One aggregate counts the cells and the fits of all columns and types; empty
    text counts as no cell. A column without any value stays text.
    """
    rows = df if first_rows is None else df.limit(first_rows)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return {}
    row = rows.agg(
        *[F.count_if(col(c) != "").alias(f"n{i}") for i, c in enumerate(texts)],
        *[F.count_if(_fits(c, t)).alias(f"{t}{i}") for i, c in enumerate(texts) for t in LOOKS_LIKE],
    ).first()
    return {
        c: next((t for t in LOOKS_LIKE if row[f"n{i}"] and row[f"{t}{i}"] == row[f"n{i}"]), "String")
        for i, c in enumerate(texts)
    }


def read_csv(
    spark: SparkSession,
    path: str,
    infer_rows: int | None = DEFAULT_INFER_ROWS,
    ignore_errors: bool = False,
    null_values: Iterable[str] = (),
    multi_line: bool = True,
) -> DataFrame:
    """A typed CSV table. A cell that does not fit its column's type, found below
    the inferred rows, raises or, with ``ignore_errors``, becomes null. Empty text
    stays so in text columns and is null in others. ``multi_line`` as in ``read_text``."""
    text = null_tokens(read_text(spark, path, multi_line), null_values)
    types = infer_types(text, infer_rows)
    cells = replace_columns(text, {c: F.when(col(c) != "", col(c)) for c, t in types.items() if t != "String"})
    return select_and_cast(cells, types, lenient=ignore_errors)


def cast_report(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """``(column_name, from_type, to_type, uncastable)``: what the chosen casts would do."""
    require_columns(df, types)
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(df.schema[c].dataType.simpleString()).alias("from_type"),
            F.lit(t).alias("to_type"),
            F.count_if(col(c).isNotNull() & cast_column(df, c, t, lenient=True).isNull()).alias("uncastable"),
        )
        for c, t in types.items()
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
