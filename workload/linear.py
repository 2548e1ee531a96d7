"""Regression from moments, importance of any model, and scoring against a contract, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.ml import contract, evaluate, linear, stacking
from tabloom.session import scratch_path
from workload.registry import query, rounded, table

_PENALTIES = (0.0, 0.01, 0.1, 1.0)
_FEATURES = ["l_quantity", "l_discount"]
_GAPPY = "CASE WHEN l_orderkey % 9 <> 0 THEN l_discount END"

# Sums of products of the centred columns by fold, and of all folds
_SUMS = f"""
    g AS (SELECT l_orderkey, l_linenumber, CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|fold 1'), 1, 8) AS BIGINT) % 5 AS fold,
                 l_quantity AS q, {_GAPPY} AS d, l_extendedprice AS p FROM lineitem),
    means AS (SELECT avg(q) AS mq, avg(d) AS md, avg(p) AS mp FROM g),
    s AS (SELECT fold, q - mq AS a, coalesce(d - md, 0) AS b, p - mp AS y FROM g, means),
    f AS (SELECT fold, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb,
                 sum(a * y) AS ay, sum(b * y) AS by_, sum(y * y) AS yy FROM s GROUP BY fold),
    t AS (SELECT sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(aa) AS aa, sum(ab) AS ab, sum(bb) AS bb, sum(ay) AS ay,
                 sum(by_) AS by_, sum(yy) AS yy FROM f)"""


def _sql_solved(source: str) -> str:
    """Normal equations of two features by Cramer's rule."""
    return f"""
    c AS (SELECT *, (aa - a * a / n) * (1 + l) AS s11, ab - a * b / n AS s12, (bb - b * b / n) * (1 + l) AS s22,
                 ay - a * y / n AS s1, by_ - b * y / n AS s2 FROM {source}),
    w AS (SELECT *, (s1 * s22 - s12 * s2) / (s11 * s22 - s12 * s12) AS w1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS w2 FROM c),
    i AS (SELECT *, (y - a * w1 - b * w2) / n AS w0 FROM w)"""


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.expr(_GAPPY).alias("l_discount"), "l_extendedprice")


def _moments(spark: SparkSession, sf_dir: str) -> linear.Moments:
    return linear.moments(_lineitem(spark, sf_dir), _FEATURES, "l_extendedprice", "l_orderkey")


_RANKED = f"""WITH {_SUMS}, p AS (SELECT unnest([{', '.join(map(str, _PENALTIES))}])::DOUBLE AS l),
    rest AS (SELECT f.fold, l, {', '.join(f't.{x} - f.{x} AS {x}' for x in 'n a b y aa ab bb ay by_ yy'.split())} FROM f, t, p),
    {_sql_solved('rest')},
    e AS (SELECT l, sum(f.yy + w0 * w0 * f.n + w1 * w1 * f.aa + w2 * w2 * f.bb + 2 * w0 * w1 * f.a + 2 * w0 * w2 * f.b + 2 * w1 * w2 * f.ab
                        - 2 * w0 * f.y - 2 * w1 * f.ay - 2 * w2 * f.by_) AS error FROM i JOIN f USING (fold) GROUP BY l)
    SELECT l AS penalty, round(error / n / 1e6, 6) AS mse, round(1 - error / (yy - y * y / n), 8) AS r2 FROM e, t"""


@query("linear_leaderboard", _RANKED)
def linear_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = linear.leaderboard(spark, _moments(spark, sf_dir), _PENALTIES)
    return board.select("penalty", F.round(F.col("mse") / 1e6, 6).alias("mse"), F.round("r2", 8).alias("r2"))


@query(
    "linear_leaderboard_best",
    f"SELECT max(penalty) AS penalty, min(mse) AS mse, max(r2) AS r2 FROM ({_RANKED})",
)
def linear_leaderboard_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest or best value of each column of the leaderboard."""
    return linear_leaderboard(spark, sf_dir).agg(F.max("penalty").alias("penalty"), F.min("mse").alias("mse"), F.max("r2").alias("r2"))


_FITTED = f"WITH {_SUMS}, one AS (SELECT 0.01 AS l, * FROM t), {_sql_solved('one')}"
_PREDICTED = f"""{_FITTED} SELECT l_orderkey, l_linenumber, round(mp + w0 + w1 * (q - mq) + w2 * coalesce(d - md, 0), 3) AS predict FROM g, means, i"""


@query("linear_predict", _PREDICTED)
def linear_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained = linear.model(_moments(spark, sf_dir), 0.01)
    return rounded(trained.predict(_lineitem(spark, sf_dir)).select("l_orderkey", "l_linenumber", "predict"), 3, "predict")


@query("linear_roundtrip", _PREDICTED)
def linear_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the model as it was saved and loaded."""
    path = linear.save(spark, linear.model(_moments(spark, sf_dir), 0.01), scratch_path(spark, "linear-model"))
    return rounded(linear.load(spark, path).predict(_lineitem(spark, sf_dir)).select("l_orderkey", "l_linenumber", "predict"), 3, "predict")


@query(
    "linear_importance",
    f"""{_FITTED}, z AS (SELECT abs(w1) * sqrt(aa / n - (a / n) * (a / n)) AS q, abs(w2) * sqrt(bb / n - (b / n) * (b / n)) AS d FROM i)
        SELECT 'l_quantity' AS variable, round(q, 4) AS importance, round(q / (q + d), 8) AS share FROM z
        UNION ALL SELECT 'l_discount', round(d, 4), round(d / (q + d), 8) FROM z""",
)
def linear_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linear.importance(spark, linear.model(_moments(spark, sf_dir), 0.01))
    return rounded(rounded(found, 4, "importance"), 8, "share")


_STACK = (0.01, 1.0)
_LEVEL_ONE = f"""WITH {_SUMS}, p AS (SELECT unnest([{', '.join(map(str, _STACK))}])::DOUBLE AS l),
    rest AS (SELECT f.fold, l, {', '.join(f't.{x} - f.{x} AS {x}' for x in 'n a b y aa ab bb ay by_ yy'.split())} FROM f, t, p),
    {_sql_solved('rest')},
    r AS (SELECT l_orderkey, l_linenumber, p AS actual, any_value(mp + w0 + w1 * (q - mq) + w2 * coalesce(d - md, 0)) FILTER (l < 0.5) AS u,
                 any_value(mp + w0 + w1 * (q - mq) + w2 * coalesce(d - md, 0)) FILTER (l > 0.5) AS v
          FROM g JOIN i USING (fold), means GROUP BY l_orderkey, l_linenumber, p),
    z AS (SELECT var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv, covar_pop(u, actual) AS ua, covar_pop(v, actual) AS va, var_pop(actual) AS aa,
                 avg((actual - u) ** 2) AS base0, avg((actual - v) ** 2) AS base1 FROM r),
    k AS (SELECT (ua * vv - uv * va) / (uu * vv - uv * uv) AS x, (uu * va - uv * ua) / (uu * vv - uv * uv) AS y, * FROM z UNION ALL
          SELECT greatest(ua / uu, 0), 0, * FROM z UNION ALL SELECT 0, greatest(va / vv, 0), * FROM z),
    o AS (SELECT *, aa - 2 * x * ua - 2 * y * va + x * x * uu + 2 * x * y * uv + y * y * vv AS loss FROM k WHERE x >= 0 AND y >= 0)"""


@query(
    "linear_stack",
    f"""{_LEVEL_ONE} SELECT round(min(loss) / 1e6, 6) AS loss, round(any_value(base0) / 1e6, 6) AS base0, round(any_value(base1) / 1e6, 6) AS base1,
           true AS weights_not_negative, bool_and(loss >= (SELECT min(loss) FROM o)) AND min(loss) <= least(any_value(base0), any_value(base1)) AS not_above_best FROM o""",
)
def linear_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of each variant and their best weights that are not negative."""
    found = stacking.stack(_lineitem(spark, sf_dir), _FEATURES, "l_extendedprice", "l_orderkey", _STACK).found
    row = (found.loss / 1e6, *[b / 1e6 for b in found.base], min(found.weights) >= 0, found.loss <= min(found.base))
    return rounded(spark.createDataFrame([row], "loss double, base0 double, base1 double, weights_not_negative boolean, not_above_best boolean"), 6, "loss", "base0", "base1")


@query(
    "permutation_importance",
    """WITH h AS (SELECT p_partkey, p_size, p_retailprice, 2 * p_size + p_retailprice / 100 AS y,
                         CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR) || '|rotate 1'), 1, 8) AS BIGINT) AS h,
                         ceil((SELECT count(*) FROM part) / 50.0) AS parts FROM part),
            r AS (SELECT *, floor(h * parts / 4294967296.0) AS ring FROM h),
            n AS (SELECT *, coalesce(lead(p_size) OVER w, first_value(p_size) OVER w) AS next_size,
                         coalesce(lead(p_retailprice) OVER w, first_value(p_retailprice) OVER w) AS next_price
                  FROM r WINDOW w AS (PARTITION BY ring ORDER BY h, p_partkey))
       SELECT 'p_size' AS variable, round(avg((2 * (p_size - next_size)) ** 2), 6) AS importance FROM n
       UNION ALL SELECT 'p_retailprice', round(avg(((p_retailprice - next_price) / 100) ** 2), 6) FROM n
       UNION ALL SELECT 'p_partkey', 0.0""",
)
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model whose effects are known: how much its loss grows with each feature from another row."""
    part = table(spark, sf_dir, "part").withColumn("y", F.expr("2 * p_size + p_retailprice / 100"))
    known = lambda df: df.withColumn("predict", F.expr("2 * p_size + p_retailprice / 100"))
    found = linear.permutation_importance(known, part, ["p_size", "p_retailprice", "p_partkey"], "y", "p_partkey", rows_per_range=50)
    return rounded(found, 6, "importance")


# -- a new table against what the model has learnt ----------------------------

_STATUS = "CASE WHEN o_orderkey % 14 = 1 THEN 'X' WHEN o_orderkey % 14 = 3 THEN NULL ELSE o_orderstatus END"
_PRICE = "CASE WHEN o_orderkey % 10 = 5 THEN o_totalprice * 100 WHEN o_orderkey % 10 = 7 THEN NULL ELSE o_totalprice END"
_SPLIT = f"""old AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0),
    fresh AS (SELECT o_orderkey, {_STATUS} AS o_orderstatus, {_PRICE} AS o_totalprice, o_totalprice * 2 AS actual FROM orders WHERE o_orderkey % 2 = 1)"""


def _scored(spark: SparkSession, sf_dir: str) -> dict:
    orders = table(spark, sf_dir, "orders")
    learnt = contract.learn(orders.filter("o_orderkey % 2 = 0"), ["o_orderstatus", "o_totalprice"])
    learnt = contract.load(spark, contract.save(spark, learnt, scratch_path(spark, "contract")))
    fresh = orders.filter("o_orderkey % 2 = 1").selectExpr("o_orderkey", f"{_STATUS} AS o_orderstatus", f"{_PRICE} AS o_totalprice", "o_totalprice * 2 AS actual")
    doubled = lambda df: df.withColumn("predict", F.col("o_totalprice") * 2 + 1)
    return contract.score_table(learnt, doubled, fresh, "actual", [evaluate.regression_metrics])


@query(
    "score_table",
    f"""WITH {_SPLIT} SELECT o_orderkey, o_orderstatus, o_totalprice, actual, o_totalprice * 2 + 1 AS predict FROM fresh""",
)
def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)["predictions"]


@query(
    "score_table_metrics",
    f"""WITH {_SPLIT}, e AS (SELECT actual AS y, o_totalprice * 2 + 1 AS p FROM fresh WHERE o_totalprice IS NOT NULL),
             m AS (SELECT count(*) AS n, avg((y - p) ** 2) AS mse, avg(abs(y - p)) AS mae, 1 - avg((y - p) ** 2) / var_pop(y) AS r2 FROM e)
        SELECT 'n' AS metric, n::DOUBLE AS value FROM m UNION ALL SELECT 'mse', round(mse / 1e9, 4) FROM m
        UNION ALL SELECT 'rmse', round(sqrt(mse), 2) FROM m UNION ALL SELECT 'mae', round(mae, 2) FROM m UNION ALL SELECT 'r2', round(r2, 4) FROM m""",
)
def score_table_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contract.union_metrics(_scored(spark, sf_dir)["metrics"])
    value = F.when(F.col("metric") == "mse", F.round(F.col("value") / 1e9, 4)).when(F.col("metric") == "r2", F.round("value", 4))
    return found.withColumn("value", value.otherwise(F.round("value", 2)))


_BIN_OF = "CASE WHEN v < lo THEN 0 WHEN v > hi THEN 11 ELSE least(floor((v - lo) / ((hi - lo) / 10)), 9) + 1 END"


@query(
    "score_table_checks",
    f"""WITH {_SPLIT}, ends AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM old),
             bins AS (SELECT b, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS q
                      FROM (SELECT side, {_BIN_OF} AS b FROM (SELECT 0 AS side, o_totalprice AS v FROM old UNION ALL SELECT 1, o_totalprice FROM fresh), ends
                            WHERE v IS NOT NULL) GROUP BY b),
             grid AS (SELECT greatest(coalesce(p, 0), 0.5) / (SELECT sum(p) FROM bins) AS p, greatest(coalesce(q, 0), 0.5) / (SELECT sum(q) FROM bins) AS q
                      FROM (SELECT unnest(range(12)) AS b) LEFT JOIN bins USING (b))
        SELECT 'o_totalprice' AS column_name, count(*) AS rows, count(*) - count(o_totalprice) AS missing,
               count(*) FILTER (o_totalprice < lo OR o_totalprice > hi) AS unseen, round((SELECT sum((q - p) * ln(q / p)) FROM grid), 8)::DOUBLE AS shift
        FROM fresh, ends
        UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(*) FILTER (o_orderstatus NOT IN (SELECT o_orderstatus FROM old)), NULL FROM fresh""",
)
def score_table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir)["checks"], 8, "shift")
