"""A feature vector from all columns but the target."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.functions.columns import is_numeric, require_columns

HASHED_FEATURES = 1 << 14  # slots of the text columns that a caller wants hashed

CLASSIFICATION, REGRESSION = "classification", "regression"


def _as_number(name: str, data_type: T.DataType) -> str | None:
    quoted = f"`{name}`"
    if is_numeric(data_type):
        return f"CAST({quoted} AS DOUBLE)"
    if isinstance(data_type, T.BooleanType):
        return f"CAST(CAST({quoted} AS INT) AS DOUBLE)"
    if isinstance(data_type, T.DateType):
        return f"CAST(unix_date({quoted}) AS DOUBLE)"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return f"unix_micros(CAST({quoted} AS TIMESTAMP)) / 1e6"
    return None


def feature_pipeline(
    df: DataFrame, target: str, leave_out: tuple[str, ...] = (), hashed: tuple[str, ...] = ()
) -> Pipeline:
    """Stages that add ``features`` to tables shaped like ``df``, with or without the target.

    Numbers, booleans, dates and times (in seconds) become doubles; a missing one
    becomes the mean over ``df``, or zero where ``df`` has no value. Texts are
    one-hot encoded, apart from those in ``hashed``, which share hashed slots.
    Other types raise unless they are left out by name.
    """
    require_columns(df, [target, *leave_out, *hashed])
    fields = [f for f in df.schema.fields if f.name not in (target, *leave_out)]
    numbers = {f.name: e for f in fields if (e := _as_number(f.name, f.dataType))}
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    other = [f"{f.name} ({f.dataType.simpleString()})" for f in fields if f.name not in numbers and f.name not in texts]
    if other:
        raise TypeError(f"no feature can be made of {', '.join(other)}; leave them out")
    if not fields:
        raise ValueError("no usable feature column")
    indexed = [c for c in texts if c not in hashed]
    hashed = [c for c in texts if c in hashed]

    stages: list = []
    inputs: list[str] = []
    if numbers:
        shown = {n: f"NULLIF({e}, CAST('NaN' AS DOUBLE))" for n, e in numbers.items()}
        means = df.agg(*[F.avg(F.expr(e)) for e in shown.values()]).first()
        filled = [
            f"COALESCE({e}, CAST('{0.0 if m is None else m!r}' AS DOUBLE)) AS `fill_{n}`"
            for (n, e), m in zip(shown.items(), means)
        ]
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__"))
        inputs += [f"fill_{n}" for n in numbers]
    if indexed:
        index, hot = [f"idx_{c}" for c in indexed], [f"hot_{c}" for c in indexed]
        stages.append(
            StringIndexer(inputCols=indexed, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc")
        )
        stages.append(OneHotEncoder(inputCols=index, outputCols=hot, handleInvalid="keep"))
        inputs += hot
    if hashed:
        stages.append(FeatureHasher(inputCols=hashed, outputCol="hashed", numFeatures=HASHED_FEATURES))
        inputs.append("hashed")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages)


def label_stage(target: str, task: str) -> StringIndexer | SQLTransformer:
    """Stage that adds ``label``; rows of a class not seen in fitting are left out."""
    if task == CLASSIFICATION:
        return StringIndexer(inputCol=target, outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc")
    if task == REGRESSION:
        return SQLTransformer(statement=f"SELECT *, CAST(`{target}` AS DOUBLE) AS label FROM __THIS__")
    raise ValueError(f"unknown task '{task}'")


def feature_names(featured: DataFrame) -> list[str]:
    """Names of the slots of ``features``, from the attributes Spark ML keeps."""
    attributes = featured.schema["features"].metadata.get("ml_attr", {})
    named = {a["idx"]: a["name"] for group in attributes.get("attrs", {}).values() for a in group if "name" in a}
    return [named.get(i, f"feature_{i}") for i in range(attributes.get("num_attrs", len(named)))]
