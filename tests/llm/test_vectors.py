"""Centroid clustering against brute force, and its bounds against sampled points."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from tabloom.llm import centroids


def brute(rows, dims, k=40, rounds=5):
    points = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(points, key=lambda p: (hashlib.sha256(f"2:{'' if p[0] is None else p[0]}".encode()).hexdigest(), p[1]))[:k]
    centers = [p for _, p in first]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        own = [min((gap(p, c), j) for j, c in enumerate(centers)) for _, p in points]
        if turn < rounds:
            for j in range(len(centers)):
                mine = [p for (_, p), (_, c) in zip(points, own) if c == j]
                if mine:
                    centers[j] = [sum(x) // len(mine) for x in zip(*mine)]
    inertia = Counter()
    for d, j in own:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(points, own))


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, point int")
    result = centroids.cluster(df, **options)
    return Counter((r["key"], r.cluster, r.own, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in result.rows.collect()), result


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.op11_centroids(spark, sf_dir).collect())
    assert got == brute(rows, 64)


@pytest.mark.parametrize("k", [1, 3, 40])
def test_awkward_vectors(spark, k):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=3).astype(np.float32)]) for i in range(30)]
    rows += [(7, rows[7][1])] * 20 + [(i, [0.5, 0.5, 0.5]) for i in range(30, 60)]  # copies of a row, copies of a vector
    rows += [(None, [1.0, 2.0, 3.0]), (None, None), (61, None), (62, [1.0, 2.0]), (63, [1.0, 2.0, 3.0, 4.0]), (64, [1.0, None, 2.0]), (65, [1.0, math.nan, 2.0]), (66, [1.0, math.inf, 2.0]), (67, [])]
    got, _ = found(spark, [(*r, "x", 1) for r in rows], dims=3, k=k)
    assert got == brute(rows, 3, k)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**i), float(-(2 ** (20 - i))), 0.25]) for i in range(21)]
    got, _ = found(spark, [(*r, "x", 1) for r in rows], dims=3, k=4)
    assert got == brute(rows, 3, 4)


def test_no_vectors(spark):
    got, result = found(spark, [], dims=3)
    assert not got and result.rows.columns == ["key", "cluster", "own", "cluster_inertia", "inertia", "centroid_sha256"]


def test_settled_vectors_are_not_scanned(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in 100 * (i % 4) + rng.normal(size=3)], "x", 1) for i in range(400)]
    _, result = found(spark, rows, dims=3, k=4)
    assert result.scanned[0] == 400 and result.scanned[-1] < 40


def test_loosening_covers_every_point_of_the_sphere_and_is_less_than_the_drift():
    rng = np.random.default_rng(7)
    less = 0
    for _ in range(40):
        old = rng.integers(-200, 200, (5, 4))
        move = centroids.Move(old, old + rng.integers(-60, 60, (5, 4)), rng.uniform(0, 120, 5))
        bound = centroids.loosening(move)
        for i in range(5):
            way = rng.normal(size=(400, 4))
            x = move.old[i] + way / np.linalg.norm(way, axis=1)[:, None] * move.reach[i] * rng.uniform(0, 1, (400, 1)) ** 0.25
            for j in range(5):
                if j != i:
                    nearer = np.linalg.norm(x - move.old[j], axis=1) - np.linalg.norm(x - move.new[j], axis=1)
                    assert nearer.max() <= bound[i]
            less += bound[i] < 0.999 * max(np.linalg.norm(move.new[j] - move.old[j]) for j in range(5) if j != i)
    assert less > 40
