"""Shared by the operators of this subpackage: columns, written tables, word expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.session import scratch_path

# The white space of the word rules: space, and tab to carriage return.
BLANK = " \t\n\u000b\f\r"
BLANKS = r"[\x20\x09-\x0D]+"


_kept: dict[str, object] = {}


def worker_table(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps between its tasks, made where it is not there. It keeps one thing only:
    workers live through all stages of a job, and the tables of earlier operators would add up."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared scratch folder, removed when the driver's JVM ends."""
    path = scratch_path(spark, name)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table in the shared scratch folder, so later steps neither
    repeat the work nor depend on executors that made it."""
    path = scratch_folder(df.sparkSession, name) + "/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> tuple[DataFrame, str]:
    """As ``written``, dealt by a key, so that joins by it do not shuffle these rows again, and the
    catalog's name of the table, which the caller drops after its last use."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_folder(spark, name) + "/rows"
    title = "tabloom_" + "".join(c if c.isalnum() else "_" for c in path.split("/")[-2])
    df.repartition(n, key).write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(n, key).saveAsTable(title)
    return spark.table(title), title


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_long(name: str) -> Column:
    return F.col(f"`{name}`").cast("long")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def blank_words(text: Column) -> Column:
    """Words between white space; no words give an empty array."""
    trimmed = F.btrim(text, F.lit(BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out a single time a row, also where
    ``use`` names it inside the function of an array element."""
    return F.transform(F.array(value), use)[0]
