"""Exact joins that rule out pairs by a few axes."""

from __future__ import annotations

import numpy as np
import pytest
from test_knn import brute, frames, pairs, unit

from addrloom.operators import knn
from addrloom.operators.distances import Reduction, principal_axes, squared_distances


def decaying(rng, rows, dim=64):
    """Vectors without clusters that spread mostly along few directions, as embeddings do."""
    v = rng.normal(size=(rows, dim)) * (0.75 ** np.arange(dim)) @ np.linalg.qr(np.random.default_rng(1).normal(size=(dim, dim)))[0]
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def test_reduced_distances_are_lower_bounds():
    rng = np.random.default_rng(2)
    for v in (decaying(rng, 300), unit(rng, 300, 20), 50.0 + unit(rng, 200, 8)):
        for axes in (1, 3, 8):
            low = Reduction(v.mean(axis=0), np.linalg.qr(rng.normal(size=(v.shape[1], axes)))[0])(v)
            assert low.shape == (len(v), axes + 1)
            true = ((v[:, None].astype(float) - v[None].astype(float)) ** 2).sum(axis=2)
            assert (((low[:, None].astype(float) - low[None].astype(float)) ** 2).sum(axis=2) <= true + 1e-5).all()


def test_fewer_numbers_are_multiplied_for_the_same_pairs():
    rng = np.random.default_rng(3)
    q, r = decaying(rng, 256), decaying(rng, 4000)
    few = principal_axes(r[:1000].astype(float))
    assert 4 * few.axes.shape[1] <= 64
    slack = knn.SLACK + knn.REST_SLACK
    row, column, multiplied = knn._may_be_best(q, r, 5, np.inf, slack, (few(q), few(r)))
    _, _, plain = knn._may_be_best(q, r, 5, np.inf, slack)
    assert multiplied + 64 * len(row) < 0.4 * plain == 0.4 * 256 * 4000 * 64
    kept = set(zip(row.tolist(), column.tolist()))
    true = squared_distances(q.astype(float), r.astype(float))
    for i in range(256):
        assert {(i, j) for j in np.argsort(true[i])[:5].tolist()} <= kept
    # an even spread leaves nothing to rule out: no axes are chosen, and forced ones fall back to the whole product
    even = unit(rng, 2000, 64)
    assert principal_axes(even.astype(float)) is None and principal_axes(np.ones((50, 8))) is None
    forced = principal_axes(even.astype(float), 4)
    row, _, multiplied = knn._may_be_best(even[:50], even, 5, np.inf, slack, (forced(even[:50]), forced(even)))
    assert multiplied > 50 * 2000 * 64 and len(row) < 50 * 20


@pytest.mark.parametrize("threshold", [None, 0.9])
@pytest.mark.parametrize("sizes", [{"axes": 6}, {"axes": 1}, {"axes": 500}, {"cell_rows": 20, "chunk_rows": 90}, {"cell_rows": 60, "axes": 6}, {"cell_rows": 60, "axes": 0}])
def test_exact_join_is_brute_force(spark, sizes, threshold):
    rng = np.random.default_rng(4)
    q, r = decaying(rng, 60, 24), decaying(rng, 700, 24)
    r[100:300] = r[100]  # a large group of copies
    q[:5] = r[:5]
    a, b = frames(spark, q, r)
    assert pairs(knn.knn_join(a, b, 4, threshold, **sizes)) == brute(q, r, 4, threshold)


def test_empty_sides(spark):
    rng = np.random.default_rng(5)
    a, b = frames(spark, decaying(rng, 3, 8), decaying(rng, 3, 8))
    assert knn.knn_join(a, b.limit(0), 2, axes=2).count() == 0 and knn.knn_join(a.limit(0), b, 2, axes=2).count() == 0
