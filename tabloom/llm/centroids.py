"""Centroid clustering whose lower bounds loosen by geometry, not by full drift.

Every vector keeps its exact squared distance to its own centroid and one lower bound on its
distance to all other centroids. When the centroids move, the vectors of a cluster lie in a sphere
around its old centroid, and for each other centroid j the plane through the sphere's centre and j's
way from ``a`` to ``b`` tells how much nearer j can have come to any point x of that sphere:

    |x-a| - |x-b| = (|x-a|^2 - |x-b|^2) / (|x-a| + |x-b|) <= |b-a| cos(x-m, b-a),  m = (a+b)/2

as ``|x-a| + |x-b| >= 2|x-m|``. Seen from m the sphere covers the angles within asin(radius / distance)
of its centre, so the smallest angle of the sphere to j's way bounds the loosening of the whole
cluster; it is zero if j moves off. Vectors nearer to their own centroid than the loosened bound
(or than half the way to the next centroid) stay; the others are scanned against all centroids.

The state of a round is a table in the shared scratch folder that the next round reads, so a lost
executor repeats tasks of one round only. Beside the vectors each Arrow batch leaves its sums for the
clusters it meets in a column of its own, so centroids are made from a narrow read. The driver holds
centroids only: ``k`` times ``dims`` numbers.

Arithmetic is exact: components are whole numbers, distances of components up to 2^22 are sums that
doubles hold, larger ones use Python's integers; bounds in doubles are taken with a margin.

Defined results: vectors with a null, a null or non-finite component or another length are left out;
a null id is hashed as empty text and kept; equal ids or copies are vectors of their own, equal hashes
are ordered by components; fewer vectors than ``k`` make that many centroids; an empty table gives no
rows; components beyond 2^62 count as 2^62, a distance or sum beyond a long as the largest long; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm.common import as_long, table, written

#: Whole numbers up to this have products whose sums over a vector are exact in doubles.
EXACT = 1 << 22
LONG = (1 << 63) - 1
MARGIN = 1e-9

STATE = (
    "key {key}, point array<bigint>, cluster int, own bigint, lower double, "
    "parts array<struct<cluster:int,n:bigint,scanned:bigint,reach:double,inertia:decimal(38,0),sums:array<decimal(38,0)>>>"
)
_PARTS = pa.list_(
    pa.struct(
        [
            ("cluster", pa.int32()), ("n", pa.int64()), ("scanned", pa.int64()), ("reach", pa.float64()),
            ("inertia", pa.decimal128(38, 0)), ("sums", pa.list_(pa.decimal128(38, 0))),
        ]
    )
)


@dataclass(frozen=True)
class Move:
    """Centroids before and after a move and how far each cluster's vectors reach."""

    old: np.ndarray
    new: np.ndarray
    reach: np.ndarray


def loosening(move: Move) -> np.ndarray:
    """For each cluster the most that any other centroid can have come nearer to any of its vectors."""
    old, new = move.old.astype(float), move.new.astype(float)
    way = new - old
    drift = np.sqrt((way**2).sum(1))
    middle = (old + new) / 2
    to = old[:, None, :] - middle[None]  # from the middle of j's way to the centre of sphere i
    far = np.sqrt((to**2).sum(2))
    along = np.einsum("ijd,jd->ij", to, way)
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip(along / (far * drift), -1, 1))
        spread = np.arcsin(np.clip(move.reach[:, None] / far, 0, 1))
    inside = far <= move.reach[:, None] * (1 + MARGIN)
    nearest = np.where(inside, 0.0, np.maximum(angle - spread - MARGIN, 0.0))
    nearer = drift * np.maximum(np.cos(nearest), 0.0)
    nearer = np.where(drift == 0, 0.0, nearer)
    np.fill_diagonal(nearer, 0.0)
    return nearer.max(1) * (1 + MARGIN) + MARGIN


def squared(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all centers."""
    if max(_largest(points), _largest(centers)) <= EXACT:
        a, b = points.astype(float), centers.astype(float)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]
    a, b = points.astype(object), centers.astype(object)
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1)


def _own(points: np.ndarray, centers: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distance of each point to the center of its cluster."""
    if max(_largest(points), _largest(centers)) <= EXACT:
        gap = points.astype(float) - centers.astype(float)[cluster]
        return np.einsum("nd,nd->n", gap, gap)
    return ((points.astype(object) - centers.astype(object)[cluster]) ** 2).sum(1)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _scan(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest center (ties: smaller number), its squared distance and a lower bound for the others."""
    gaps = squared(points, centers)
    cluster = gaps.argmin(1).astype(np.int32)
    at = np.arange(len(points)), cluster
    others = gaps.astype(float)
    others[at] = np.inf
    return cluster, gaps[at], np.sqrt(others.min(1)) * (1 - MARGIN)


def _half(centers: np.ndarray) -> np.ndarray:
    """Half the distance of each center to the next one."""
    gaps = squared(centers, centers).astype(float)
    np.fill_diagonal(gaps, np.inf)
    return np.sqrt(gaps.min(1)) / 2


def _parts(points: np.ndarray, cluster: np.ndarray, own: np.ndarray, scanned: np.ndarray) -> list[dict]:
    out = []
    exact = points if _largest(points) <= EXACT else points.astype(object)
    for c in np.unique(cluster).tolist():
        mine = cluster == c
        out.append(
            {
                "cluster": c, "n": int(mine.sum()), "scanned": int(scanned[mine].sum()),
                "reach": float(np.sqrt(float(own[mine].max()))) * (1 + MARGIN),
                "inertia": Decimal(int(own[mine].sum())), "sums": [Decimal(int(s)) for s in exact[mine].sum(0)],
            }
        )
    return out


def _pass(centers: np.ndarray, move: Move | None):
    """A round over Arrow batches: with no move yet all vectors are scanned."""
    loose = None if move is None else loosening(move)
    half = _half(centers)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            points = batch.column("point").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            if loose is None:
                scanned = np.ones(n, bool)
                cluster, own, lower = _scan(points, centers)
            else:
                cluster = batch.column("cluster").to_numpy(zero_copy_only=False).copy()
                own = _own(points, centers, cluster)
                near = np.sqrt(own.astype(float)) * (1 + MARGIN)
                lower = batch.column("lower").to_numpy(zero_copy_only=False) - loose[cluster]
                lower = np.maximum(lower, 2 * half[cluster] * (1 - MARGIN) - near)
                scanned = ~(near < lower)
                if scanned.any():
                    cluster[scanned], own[scanned], lower[scanned] = _scan(points[scanned], centers)
            parts = [_parts(points, cluster, own, scanned), *[None] * (n - 1)]
            kept = np.array([min(int(x), LONG) for x in own], np.int64) if own.dtype == object else own.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("point"), pa.array(cluster, pa.int32()), pa.array(kept), pa.array(lower), pa.array(parts, _PARTS)],
                ["key", "point", "cluster", "own", "lower", "parts"],
            )

    return run


def whole_vectors(vectors: DataFrame, key: str, column: str, dims: int, scale: int) -> DataFrame:
    """``(key, point)`` of the vectors with ``dims`` finite components, as whole numbers."""
    x = F.col(f"`{column}`")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    end = float(1 << 62)
    number = F.transform(x, lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(end)), F.lit(-end))).cast("bigint"))
    return vectors.filter(x.isNotNull() & (F.size(x) == dims)).filter(finite).select(F.col(f"`{key}`").alias("key"), number.alias("point"))


def _first(points: DataFrame, k: int, seed: str) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    rows = points.select(digest.alias("digest"), "point").orderBy("digest", "point").limit(k).collect()
    return np.array([r.point for r in rows], np.int64)


def _sums(state: DataFrame) -> list:
    """One row for each cluster and component (at place 0 the counts): at most k * (dims + 1) rows."""
    each = state.filter("parts IS NOT NULL").select(F.explode("parts").alias("p")).select("p.*")
    counted = F.concat(F.array(F.col("n").cast("decimal(38,0)")), "sums")
    return (
        each.select("cluster", "scanned", "reach", "inertia", F.posexplode(counted).alias("place", "value"))
        .groupBy("cluster", "place")
        .agg(F.sum("value").alias("value"), F.max("reach").alias("reach"), F.sum("scanned").alias("scanned"), F.sum("inertia").alias("inertia"))
        .collect()
    )


@dataclass(frozen=True)
class Clustering:
    """``rows`` are (key, cluster, own, cluster_inertia, inertia, centroid_sha256); ``scanned`` counts
    the vectors that each assignment compared with all centroids."""

    rows: DataFrame
    centers: np.ndarray
    scanned: list[int]


def cluster(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2:") -> Clustering:
    """Lloyd's rounds from the ``k`` vectors with the smallest hashes, then one more assignment."""
    spark = vectors.sparkSession
    points = whole_vectors(vectors, key, column, dims, scale)
    kind = vectors.schema[key].dataType.simpleString()
    centers = _first(points, k, seed)
    if not len(centers):
        empty = f"key {kind}, cluster int, own bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return Clustering(spark.createDataFrame([], empty), centers, [])
    schema = STATE.format(key=kind)
    state, move, scanned = points, None, []
    for turn in range(rounds + 1):
        state = written(state.mapInArrow(_pass(centers, move), schema), f"centroids-{turn}")
        sums = _sums(state)
        scanned.append(sum(int(r.scanned) for r in sums if r.place == 0))
        if turn == rounds:
            break
        new, reach = centers.astype(object), np.zeros(len(centers))
        count = {r.cluster: int(r.value) for r in sums if r.place == 0}
        for r in sums:
            if r.place:
                new[r.cluster, r.place - 1] = int(r.value) // count[r.cluster]
            reach[r.cluster] = r.reach
        move = Move(centers, new.astype(np.int64), reach)
        centers = move.new
    inertia = {r.cluster: int(r.inertia) for r in sums if r.place == 0}
    total = min(sum(inertia.values()), LONG)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centers]
    each = [(c, min(x, LONG), total, digest[c]) for c, x in sorted(inertia.items())]
    names = spark.createDataFrame(each, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # one row a centroid
    rows = state.select("key", "cluster", "own").join(F.broadcast(names), "cluster").select("key", "cluster", "own", "cluster_inertia", "inertia", "centroid_sha256")
    return Clustering(rows, centers, scanned)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(as_long("vec_id").alias("vec_id"), "embedding")
    return cluster(vectors).rows.withColumnsRenamed({"key": "vec_id", "own": "distance"})
