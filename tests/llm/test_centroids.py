"""The threshold walk and the clustering against comparing everything."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from addrloom.llm import centroids


@pytest.mark.parametrize("rows, dimensions, k, spread", [(200, 64, 16, 20), (300, 2, 40, 5), (50, 3, 1, 4), (100, 1, 9, 3), (80, 5, 7, 1000)])
def test_nearest(rows, dimensions, k, spread):
    rng = np.random.default_rng(rows)
    x, c = rng.integers(-spread, spread + 1, (rows, dimensions)), rng.integers(-spread, spread + 1, (k, dimensions))
    c[k // 2] = c[0]  # a tie for good
    cluster, distance, steps = centroids.SortedLists(c).nearest(x)
    every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert steps.max() <= k


def test_the_walk_stops_early():
    rng = np.random.default_rng(2)
    c = rng.integers(-10**6, 10**6, (200, 2))
    _, _, steps = centroids.SortedLists(c).nearest(c + 1)
    assert steps.mean() < 10


def brute(rows, dimensions, k, rounds, seed=1):
    kept = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], np.int64)
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in order[:k]]

    def nearest():
        every = ((x[:, None] - np.array(c)[None]) ** 2).sum(axis=2)
        return every.argmin(axis=1), every.min(axis=1)

    for _ in range(rounds):
        to, _ = nearest()
        c = [[int(s) // int((to == j).sum()) for s in x[to == j].sum(axis=0)] if (to == j).any() else c[j] for j in range(len(c))]
    to, far = nearest()
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted(((i, int(a), int(b), int(far[to == a].sum()), int(far.sum()), sha[a]) for (i, _), a, b in zip(kept, to, far)), key=str)


@pytest.mark.parametrize("k, rounds", [(16, 3), (4, 1), (300, 2)])
def test_cluster(spark, k, rounds):
    rng = np.random.default_rng(k)
    vectors = rng.normal(size=(150, 8)).astype(np.float32)
    vectors = np.concatenate((vectors, np.repeat(vectors[:1], 70, axis=0)))  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(500, None), (501, [1.0] * 7), (502, [None] + [1.0] * 7), (503, [float("nan")] * 8), (504, [float("-inf")] * 8), (None, rows[4][1]), (7, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", centroids.F.lit("x")).repartition(6)
    out = centroids.cluster(df, dimensions=8, centroids=k, rounds=rounds, carry=("cluster",)).collect()
    assert {r["row"]["cluster"] for r in out} == {"x"}
    found = sorted(((r["row"]["vec_id"], *r[1:]) for r in out), key=str)
    assert found == brute(rows, 8, k, rounds)


def test_without_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<double>")
    assert centroids.cluster(df).collect() == [] and centroids.cluster(df.limit(0)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(None, [1.0])], df.schema), dimensions=1).collect() == []
