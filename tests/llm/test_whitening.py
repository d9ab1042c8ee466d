"""Spectra against a dense solver, and the whitened rows against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest

from addrloom.llm import whitening
from addrloom.llm.whitening import OFFSET, SCALE, Spectrum


def spectrum_of(rows):
    out = Spectrum.empty(rows.shape[1])
    for x in rows:
        out.add(x)
    return out


def dense(rows):
    off = rows - rows.mean(axis=0)
    return off.T @ off / len(rows)


def check(found, rows):
    want, top = dense(rows), max(np.linalg.eigvalsh(dense(rows))[-1], 1e-300)
    assert found.count == len(rows) and (found.total == rows.sum(axis=0)).all()
    assert np.abs(found.vectors.T @ found.vectors - np.eye(rows.shape[1])).max() < 1e-12
    assert np.abs(found.vectors * found.values @ found.vectors.T - want).max() / top < 1e-11
    assert (np.diff(found.values) >= -1e-12 * top).all()


@pytest.mark.parametrize("kind", ["plain", "rank", "repeated", "constant", "axis", "one", "scales", "few"])
def test_updates_and_merges(kind):
    rng = np.random.default_rng(12)
    rows = (rng.normal(size=(300, 12)) * np.linspace(1, 9, 12) * 20).astype(np.int64) + OFFSET
    if kind == "rank":
        rows[:, 3], rows[:, 7] = rows[:, 2], 2 * rows[:, 4] - rows[:, 5]
    elif kind == "repeated":
        rows = np.repeat(rows[:8], 20, axis=0)
    elif kind == "constant":
        rows[:, [0, 5, 11]] = 7
    elif kind == "axis":  # every vector touches one direction: all others are deflated
        rows = np.repeat(np.eye(12, dtype=np.int64), 5, axis=0) * np.arange(1, 61)[:, None] + OFFSET
    elif kind == "one":
        rows = rows[:, :1]
    elif kind == "scales":
        rows = OFFSET + ((rows - OFFSET) * np.logspace(-1, 4, 12)).astype(np.int64)
    elif kind == "few":
        rows = rows[:3]
    check(spectrum_of(rows), rows)
    cut = max(1, len(rows) // 3)
    check(spectrum_of(rows[:cut]).merge(spectrum_of(rows[cut:])), rows)


def test_equal_vectors_have_no_spectrum():
    rows = np.full((6, 4), OFFSET)
    assert np.abs(spectrum_of(rows).values).max() == 0


def test_secular_roots():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        poles, weights = np.sort(rng.normal(size=n)) * 10.0 ** rng.integers(-3, 4), rng.random(n) ** 8 + 1e-9
        origin, away = whitening.secular_roots(poles, weights)
        want = np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(weights), np.sqrt(weights)))
        assert np.abs(poles[origin] + away - want).max() < 1e-12 * max(1, np.abs(want).max())


def brute(vectors, components):
    x = np.array([np.floor(SCALE * np.array(v, float)) for v in vectors]).astype(np.int64) + OFFSET
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    off = (n * fit - total) / n
    values, axes = np.linalg.eigh(off.T @ off / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, ((n * x - total) ** 2).sum(axis=1), ((n * x - total) / n) @ axes / np.sqrt(values), values / np.trace(off.T @ off / n)


@pytest.mark.parametrize("rows_per_task, fan_in", [(4096, 8), (40, 2)])
def test_whiten(spark, monkeypatch, rows_per_task, fan_in):
    monkeypatch.setattr(whitening, "ROWS_PER_TASK", rows_per_task)
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(230, 20)) * np.linspace(3, 0.5, 20)).astype(np.float32)
    vectors = np.concatenate((vectors, np.repeat(vectors[:1], 150, axis=0)))  # one vector with a third of the rows
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    odd = [(None, vectors[5].tolist(), "y"), (900, None, "n"), (901, [1.0, None] + [0.0] * 18, "n"), (902, [float("nan")] * 20, "n"),
           (903, [float("inf")] + [0.0] * 19, "n"), (904, [], "n"), (905, [1.0] * 19, "n")]
    df = spark.createDataFrame(rows + odd, "vec_id int, embedding array<float>, whitened string").repartition(7)
    out = whitening.whiten(df, ("vec_id", "whitened")).collect()
    assert sum(r["row"]["vec_id"] is None for r in out) == 1 and all(r["row"]["whitened"] != "n" for r in out)
    out = sorted((r for r in out if r["row"]["vec_id"] is not None), key=lambda r: r["row"]["vec_id"])
    n, deviation, whitened, explained = brute(vectors, 16)
    assert len(out) == len(vectors) and {r["n"] for r in out} == {n} == {230}
    assert [r["deviation"] for r in out] == deviation.tolist()
    found = np.array([r["whitened"] for r in out])
    sign = np.sign((found * whitened).sum(axis=0))
    assert found.shape == (380, 16) and np.abs(found * sign - whitened).max() < 1e-9
    assert np.abs(np.array(out[0]["explained"]) / explained - 1).max() < 1e-10
    assert len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-10


def test_flat_empty_and_short(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    # equal vectors: counted, at distance zero, without a component
    out = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"]) for r in out] == [(1, 0, [])] * 2
    # two different vectors vary in one direction
    out = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert sorted(round(r["whitened"][0], 12) for r in out) == [-1.0, 1.0] and out[0]["explained"] == [1.0]
    # the commonest length; of two the longer
    out = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [3.0, 2.0])], schema)).collect()
    assert [r["row"]["vec_id"] for r in out] == [2]
