"""Joining two tables on one shared column.

Catalyst broadcasts a side it knows to be small and AQE splits skewed partitions at run time, but only
of a side whose unmatched rows the join keeps or drops one by one: both sides of an inner join, the left
side of a left join, the right side of a right join, none of a full outer join. For the other sides hot
keys are looked for first: frequency sketches of the key, merged in two steps, name the keys that can be
hot, an exact count of those decides, and the result is a small table of key hashes and buckets.

Rows of a hot key are dealt over its buckets, the partner rows are repeated in each. Equal rows would
fall into one bucket, so rows of hot keys are collapsed to (row, n) first, n is dealt over the buckets,
and the copies are made again after the join. Buckets are hashes of rows, so a task that runs again deals
alike. The table decides speed only: any table, also one of other data, gives the same join.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.functions.columns import DuplicateColumn, MissingColumn, col, field_type, is_numeric

SALTS = 64
JOIN_TYPES = ("inner", "left", "right", "outer")
#: Sides whose hot keys AQE cannot split.
UNSPLIT = {"inner": (), "left": ("right",), "right": ("left",), "outer": ("left", "right")}
BUCKET_ROWS = 1_000_000  # rows of a bucket; a key with more is hot
#: A sketch of so many items finds every key with 1/2000 of a side's rows or more; rarer keys are no
#: larger than a part of a shuffle should be. So many keys are at most listed for a side.
TRACKED, LISTED = 8_192, 4_000
SKETCHES = 64  # sketches of tasks are merged in so many groups first

_HASH, _L, _R, _SALTS, _EQUAL, _TURN = (f"__tabloom_{n}" for n in ("hash", "l", "r", "salts", "equal", "turn"))


@dataclass(frozen=True)
class HotKeys:
    """Tables ``(hash, salts)`` of the hot keys of either side, None where there is none.

    ``hash`` is ``xxhash64`` of the key as ``key_type``; a null key has one too."""

    key_type: T.DataType
    left: DataFrame | None = None
    right: DataFrame | None = None


def merge(
    left: DataFrame,
    right: DataFrame,
    join_column: str,
    join_type: str = "inner",
    hot_keys: HotKeys | dict[str, list[Any]] | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join on ``join_column``; null keys never match, an outer key is coalesced.

    Columns keep the left order, then the right order; a right column whose name the left table already
    has gets the suffix ``_right``. Without ``hot_keys`` those AQE cannot split are looked for (a job over
    the keys); a result of ``find_hot_keys`` saves that job, and ``{"left": [...], "right": [...]}`` names
    keys, null included, to be dealt over ``salts`` buckets. Streams are joined as they come.
    """
    if join_type not in JOIN_TYPES:
        raise ValueError(f"unknown join type '{join_type}'; choose one of {JOIN_TYPES}")
    _check_key(left, right, join_column)
    right = _suffix_collisions(left, right, join_column)
    names = left.columns + [c for c in right.columns if c != join_column]

    if left.isStreaming or right.isStreaming:
        hot_keys = {}
    if hot_keys is None:
        hot_keys = find_hot_keys(left, right, join_column, UNSPLIT[join_type])
    elif isinstance(hot_keys, dict):
        hot_keys = _named_keys(left, right, join_column, hot_keys, salts)
    if hot_keys.left is not None or hot_keys.right is not None:
        joined = _salted(left, right, join_column, join_type, hot_keys)
    else:
        joined = left.join(right, on=[join_column], how=join_type)
    return joined.select(*[col(c) for c in names])


def _check_key(left: DataFrame, right: DataFrame, key: str) -> None:
    for side, df in (("left", left), ("right", right)):
        if key not in df.columns:
            raise MissingColumn(
                f"merge failed: the {side} table has no column '{key}'; "
                f"left columns {left.columns}, right columns {right.columns}"
            )
    a, b = field_type(left, key), field_type(right, key)
    if a != b and not (is_numeric(a) and is_numeric(b)):
        raise TypeError(f"join column '{key}' is {a.simpleString()} on the left and {b.simpleString()} on the right")


def _suffix_collisions(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    renamed = {c: f"{c}_right" for c in right.columns if c != key and c in left.columns}
    final = left.columns + [renamed.get(c, c) for c in right.columns if c != key]
    if len(set(final)) < len(final):
        raise DuplicateColumn(f"the merged table would repeat names among {final}")
    return right.withColumnsRenamed(renamed)


def _common_type(left: DataFrame, right: DataFrame, key: str) -> T.DataType:
    """The type in which a join compares the keys."""
    nulls = [F.lit(None).cast(field_type(df, key)) for df in (left, right)]
    return left.sparkSession.range(0).select(F.coalesce(*nulls).alias("key")).schema["key"].dataType


def _key_hash(key: str, key_type: T.DataType) -> Column:
    return F.xxhash64(col(key).cast(key_type))


def _broadcast_by_size(df: DataFrame) -> bool:
    """Whether the planner takes the side for small enough to be broadcast, by its own estimate."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    bytes_ = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit)
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= bytes_


def find_hot_keys(
    left: DataFrame, right: DataFrame, key: str, sides: Collection[str] = ("left", "right"), bucket_rows: int | None = None
) -> HotKeys:
    """Keys with more than ``bucket_rows`` rows on a side, null included, counted exactly among those
    the sketches name. A single side that the planner is going to broadcast is not looked at."""
    _check_key(left, right, key)
    bucket_rows = bucket_rows or BUCKET_ROWS
    key_type = _common_type(left, right, key)
    asked = {side: df for side, df in (("left", left), ("right", right)) if side in sides}
    if not asked or len(asked) == 1 and _broadcast_by_size(*asked.values()):
        return HotKeys(key_type)
    hashes = reduce(
        DataFrame.unionByName,
        [df.select(F.lit(side).alias("side"), _key_hash(key, key_type).alias("hash")) for side, df in asked.items()],
    )
    merged = (
        hashes.withColumn("group", F.spark_partition_id() % SKETCHES)
        .groupBy("side", "group").agg(F.expr(f"approx_top_k_accumulate(hash, {TRACKED})").alias("sketch"))
        .groupBy("side").agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"))
    )
    listed = merged.select("side", F.explode(F.expr(f"approx_top_k_estimate(sketch, {LISTED})")).alias("item"))
    # at most LISTED rows a side, which become small tables of the plan
    likely = listed.filter(F.col("item.count") > bucket_rows).select("side", F.col("item.item").alias("hash")).collect()
    if not likely:
        return HotKeys(key_type)
    spark = left.sparkSession
    named = spark.createDataFrame(likely, "side string, hash bigint")
    counted = hashes.join(F.broadcast(named), ["side", "hash"], "left_semi").groupBy("side", "hash").count()
    hot: dict[str, list[tuple[int, int]]] = {}
    for r in counted.filter(F.col("count") > bucket_rows).collect():
        hot.setdefault(r["side"], []).append((r["hash"], -(-r["count"] // bucket_rows)))
    return HotKeys(key_type, **{side: spark.createDataFrame(rows, "hash bigint, salts bigint") for side, rows in hot.items()})


def _named_keys(left: DataFrame, right: DataFrame, key: str, named: dict[str, list[Any]], salts: int) -> HotKeys:
    """The table of keys a caller has listed, each with the same number of buckets."""
    key_type, spark = _common_type(left, right, key), left.sparkSession
    tables = {}
    for side, values in named.items():
        if values:
            rows = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("key", key_type)]))
            tables[side] = rows.select(_key_hash("key", key_type).alias("hash"), F.lit(salts).cast("bigint").alias("salts")).distinct()
    return HotKeys(key_type, **tables)


def _salted(left: DataFrame, right: DataFrame, key: str, join_type: str, hot: HotKeys) -> DataFrame:
    a = _repeated(_dealt(left, key, hot, hot.left, _L), key, hot, hot.right, _R)
    b = _repeated(_dealt(right, key, hot, hot.right, _R), key, hot, hot.left, _L)

    # the join itself can keep the unmatched rows of a side it does not repeat
    kept = "inner"
    if join_type in ("left", "outer") and hot.right is None:
        kept = "left"
    elif join_type in ("right", "outer") and hot.left is None:
        kept = "right"
    joined = a.join(b, on=[key, _L, _R], how=kept)
    for name, table in ((_L, hot.left), (_R, hot.right)):
        joined = _expanded(joined, name) if table is not None else joined
    joined = joined.drop(_L, _R)
    if join_type in ("left", "outer") and kept != "left":
        joined = joined.unionByName(_without_partner(left, right, key, hot, hot.left), allowMissingColumns=True)
    if join_type in ("right", "outer") and kept != "right":
        joined = joined.unionByName(_without_partner(right, left, key, hot, hot.right), allowMissingColumns=True)
    return joined


def _marked(df: DataFrame, key: str, hot: HotKeys, table: DataFrame) -> DataFrame:
    """``df`` with the number of buckets of its key, null if the key is not hot."""
    named = table.select(F.col("hash").alias(_HASH), F.col("salts").alias(_SALTS))
    # at most LISTED rows
    return df.withColumn(_HASH, _key_hash(key, hot.key_type)).join(F.broadcast(named), _HASH, "left").drop(_HASH)


def _groupable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _groupable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_groupable(f.dataType) for f in data_type.fields)
    return not isinstance(data_type, (T.MapType, T.VariantType))


def _dealt(df: DataFrame, key: str, hot: HotKeys, table: DataFrame | None, name: str) -> DataFrame:
    """``df`` with a bucket; rows of hot keys are collapsed, and ``<name>_n`` is the number of equal
    rows that a row stands for in its bucket."""
    if table is None:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    marked = _marked(df, key, hot, table)
    copies = f"{name}_n"
    cold = marked.filter(F.col(_SALTS).isNull()).drop(_SALTS).withColumns({name: F.lit(0).cast("bigint"), copies: F.lit(1).cast("bigint")})
    plain = [f.name for f in df.schema.fields if _groupable(f.dataType)]
    rest = [c for c in df.columns if c not in plain]
    # columns that cannot be grouped are compared by their text
    as_text = {f"{_EQUAL}_{i}": F.to_json(F.struct(col(c)), {"ignoreNullFields": "false"}) for i, c in enumerate(rest)}
    equal = (
        marked.filter(F.col(_SALTS).isNotNull()).withColumns(as_text)
        .groupBy(*[col(c) for c in plain], *as_text, _SALTS)
        .agg(F.count(F.lit(1)).alias(_EQUAL), *[F.any_value(col(c)).alias(c) for c in rest])
    )
    first = F.xxhash64(*[col(c) for c in plain], *[F.col(c) for c in as_text])
    used = F.least(F.col(_EQUAL), F.col(_SALTS))
    turns = equal.withColumn(_HASH, first).withColumn(_TURN, F.explode(F.sequence(F.lit(0).cast("bigint"), used - 1)))
    share = F.floor(F.col(_EQUAL) / used) + F.when(F.col(_TURN) < F.col(_EQUAL) % used, 1).otherwise(0)
    bucket = F.pmod(F.pmod(F.col(_HASH), F.col(_SALTS)) + F.col(_TURN), F.col(_SALTS))
    hot_rows = turns.select(*[col(c) for c in df.columns], bucket.alias(name), share.cast("bigint").alias(copies))
    return cold.select(*hot_rows.columns).unionByName(hot_rows)


def _repeated(df: DataFrame, key: str, hot: HotKeys, table: DataFrame | None, name: str) -> DataFrame:
    """The rows that meet a hot key of the other side once per bucket, the others once."""
    if table is None:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    every = F.when(col(key).isNotNull() & F.col(_SALTS).isNotNull(), F.sequence(zero, F.col(_SALTS) - 1)).otherwise(F.array(zero))
    return _marked(df, key, hot, table).withColumn(name, F.explode(every)).drop(_SALTS)


def _expanded(df: DataFrame, name: str) -> DataFrame:
    """Each row as often as it stands for; rows without that side stand for themselves."""
    times = F.coalesce(F.col(f"{name}_n"), F.lit(1))
    return df.withColumn(_TURN, F.explode(F.sequence(F.lit(1).cast("bigint"), times))).drop(_TURN, f"{name}_n")


def _without_partner(df: DataFrame, other: DataFrame, key: str, hot: HotKeys, table: DataFrame | None) -> DataFrame:
    # null keys have no partner by definition, so they skip the shuffle
    keyed = _dealt(df.filter(col(key).isNotNull()), key, hot, table, _L)
    partners = _repeated(other.select(col(key)).distinct(), key, hot, table, _L)
    alone = keyed.join(partners, on=[key, _L], how="left_anti")
    alone = (_expanded(alone, _L) if table is not None else alone).drop(_L)
    return alone.unionByName(df.filter(col(key).isNull()))


def join_key_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns both tables have, with distinct keys on each side and the keys that match."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        return left.sparkSession.createDataFrame(
            [], "column_name string, left_keys bigint, right_keys bigint, matched_keys bigint"
        )
    sides = [
        df.select(*[col(c).cast("string").alias(c) for c in shared])
        .unpivot([], [col(c) for c in shared], "column_name", "key")
        .select("column_name", "key", F.lit(l).alias("l"), F.lit(r).alias("r"))
        for df, l, r in ((left, 1, 0), (right, 0, 1))
    ]
    per_key = (
        sides[0]
        .unionByName(sides[1])
        .groupBy("column_name", "key")
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )
    known = F.col("key").isNotNull()
    return per_key.groupBy("column_name").agg(
        F.count_if(known & (F.col("l") == 1)).alias("left_keys"),
        F.count_if(known & (F.col("r") == 1)).alias("right_keys"),
        F.count_if(known & (F.col("l") == 1) & (F.col("r") == 1)).alias("matched_keys"),
    )


def merge_preview(
    left: DataFrame, right: DataFrame, join_column: str, join_type: str, n: int, order_by: list[str]
) -> DataFrame:
    """The first ``n`` merged rows in the given order."""
    return merge(left, right, join_column, join_type).orderBy(*[col(c) for c in order_by]).limit(n)
