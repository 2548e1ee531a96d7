"""Tables in the shared scratch folder that a later job reads instead of repeating work."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabloom.session import scratch_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows read back from parquet in the folder ``spark.checkpoint.dir`` names, so that neither
    their plan is run again nor a lost executor takes them along; the folder goes when the driver ends."""
    path = scratch_folder(df.sparkSession, name) + "/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
