"""Named versions of a dataset, kept as tables of steps."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, functions as F

from tabloom.plans.recipe import Library, Step, replay

# Columns of a step table
STEP_SCHEMA = "id bigint, version_id bigint, operation_type string, parameters string"
DEFAULT_VERSION = "Default Version"


def step_log(steps: DataFrame, version_id: int, removed: DataFrame | None = None) -> DataFrame:
    """The live steps of one version; ``removed`` holds the ids of deleted steps."""
    of_version = steps.filter(F.col("version_id") == version_id)
    if removed is not None:
        of_version = of_version.join(removed.select("id"), "id", "left_anti")
    return of_version


def load_steps(steps: DataFrame, version_id: int, removed: DataFrame | None = None) -> list[Step]:
    """The live steps of one version in id order, ready to replay."""
    rows = step_log(steps, version_id, removed).orderBy("id").collect()
    return [Step.from_json(r["operation_type"], r["parameters"]) for r in rows]


def logged(steps: list[Step], version_id: int, spark: Any, first_id: int = 1) -> DataFrame:
    """Steps as rows to append to a step table."""
    rows = [
        (first_id + i, version_id, s.operation_type, json.dumps(s.parameters)) for i, s in enumerate(steps)
    ]
    return spark.createDataFrame(rows, STEP_SCHEMA)


def version_from_base(
    steps: DataFrame, base_version: int, new_version: int, added: DataFrame | None = None
) -> DataFrame:
    """Rows of a new version: the base's steps, then the added ones.

    Ids move right behind the largest id of the log and keep their distances, which
    needs the ends of each part, not a numbering of the rows. A fork takes as many
    ids as its parts span, so ids grow by the same step with each fork.
    """
    of_base = F.when(F.col("version_id") == base_version, F.col("id"))
    last, first, final = steps.agg(F.max("id"), F.min(of_base), F.max(of_base)).first()
    following = (last or 0) + 1
    parts = step_log(steps, base_version).withColumn("id", F.col("id") + F.lit(following - (first or 0)))
    if added is not None:
        following += 0 if first is None else final - first + 1
        start = added.agg(F.min("id")).first()[0] or 0
        parts = parts.unionByName(added.withColumn("id", F.col("id") + F.lit(following - start)))
    return parts.select(
        F.col("id").cast("bigint").alias("id"),
        F.lit(new_version).cast("bigint").alias("version_id"),
        "operation_type",
        "parameters",
    )


def materialise(
    df: DataFrame,
    steps: list[Step],
    base: str,
    name: str,
    version: str = DEFAULT_VERSION,
    library: Library | None = None,
) -> DataFrame:
    """Write a version as parquet below ``base`` and return it as read back."""
    path = f"{base.rstrip('/')}/{name}/{version.replace(' ', '_')}"
    replay(df, steps, library).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
