"""A fitted recipe over new files of a folder, as a stream.

The steps of a fitted recipe are projections, filters and joins with a static
table, all of which Structured Streaming runs as they are.
"""

from __future__ import annotations

from pyspark.sql import SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from tabloom.plans.recipe import FittedRecipe


def replay_new_files(
    spark: SparkSession, source: str, schema: T.StructType, recipe: FittedRecipe, target: str, checkpoint: str
) -> StreamingQuery:
    """Apply the recipe to the parquet files not seen before and append the result."""
    rows = spark.readStream.schema(schema).parquet(source)
    return (
        recipe.apply(rows)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
