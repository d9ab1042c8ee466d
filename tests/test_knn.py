from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from addrloom.operators import knn

QUERY = "source_id string, enterprise_name string, address string, vector array<float>"
REFERENCE = "source_id string, address string, room_no string, vector array<float>"


def unit(rng, rows, dim):
    v = rng.normal(size=(rows, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def frames(spark, q, r):
    return (
        spark.createDataFrame([(f"q{i}", "n", "a", [float(x) for x in v]) for i, v in enumerate(q)], QUERY),
        spark.createDataFrame([(f"r{i}", "b", "1", [float(x) for x in v]) for i, v in enumerate(r)], REFERENCE),
    )


def brute(q, r, top_n, threshold=None):
    out = set()
    for i, v in enumerate(q):
        gap = r.astype(float) - v.astype(float)
        similarity = 1 - (gap * gap).sum(axis=1) / 2
        best = sorted(range(len(r)), key=lambda j: (-round(similarity[j], 12), f"r{j}"))[:top_n]
        out |= {(f"q{i}", f"r{j}") for j in best if threshold is None or similarity[j] >= threshold}
    return out


def pairs(df):
    rows = [(x["enterprise_id"], x["standard_id"]) for x in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def clustered():
    """Clusters of very different size: one holds over a third of all rows, and
    a third of the references are copies of one vector."""
    rng = np.random.default_rng(7)
    centres = unit(rng, 12, 16)
    where = np.where(rng.random(400) < 0.4, 0, rng.integers(0, 12, 400))
    r = centres[where] + 0.05 * rng.normal(size=(400, 16))
    r = (r / np.linalg.norm(r, axis=1, keepdims=True)).astype(np.float32)
    r[250:390] = r[250]
    q = centres[np.where(rng.random(150) < 0.4, 0, rng.integers(0, 12, 150))] + 0.05 * rng.normal(size=(150, 16))
    return (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32), r


@pytest.mark.parametrize("threshold", [None, 0.9])
@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 30}, {"cell_rows": 50, "chunk_rows": 20}])
def test_exact_join_is_brute_force(spark, clustered, threshold, sizes):
    q, r = clustered
    a, b = frames(spark, q, r)
    assert pairs(knn.knn_join(a, b, 7, threshold, **sizes)) == brute(q, r, 7, threshold)


def test_exact_join_on_random_vectors(spark):
    rng = np.random.default_rng(1)
    q, r = unit(rng, 60, 8), unit(rng, 300, 8)
    a, b = frames(spark, q, r)
    assert pairs(knn.knn_join(a, b, 5, cell_rows=20, chunk_rows=16)) == brute(q, r, 5)


def test_cells_are_skipped_only_when_out_of_reach(clustered):
    q, r = clustered
    centres = r[:20].astype(float)
    squared = knn._squared_distances(r.astype(float), centres)
    cell, near = squared.argmin(axis=1), np.sqrt(squared.min(axis=1))
    rows = np.bincount(cell, minlength=20)
    radius = np.array([near[cell == c].max(initial=0) for c in range(20)])
    nearest = np.full((20, 5), np.inf)
    for c in range(20):
        s = np.sort(near[cell == c])[:5]
        nearest[c, : len(s)] = s
    chosen = knn._cells_to_search(q.astype(float), knn.Cells(centres, rows, radius, nearest), 5, np.inf)
    assert not chosen.all(), "clustered data must allow skipping"
    for i, v in enumerate(q):
        best = np.argsort(((r.astype(float) - v) ** 2).sum(axis=1))[:5]
        assert chosen[i][cell[best]].all()


def test_short_results_and_missing_vectors(spark):
    q = spark.createDataFrame([("1", None, "a", [1.0, 0.0]), ("2", "x", "b", None)], QUERY)
    r = spark.createDataFrame([("s1", "c", None, [1.0, 0.0]), ("s2", "d", "9", [-1.0, 0.0]), ("s3", "e", "", None)], REFERENCE)
    rows = {(x["enterprise_id"], x["standard_id"], x["room_no"]): x["similarity"] for x in knn.knn_join(q, r, 10).collect()}
    assert rows == {("1", "s1", ""): 1.0, ("1", "s2", "9"): -1.0}
    # the range of the cosine is [-1, 1]: a threshold of 0 drops negative ones
    assert pairs(knn.knn_join(q, r, 10, 0.0)) == {("1", "s1")}
    # the threshold comes after the top n, and a query without rows is absent
    assert knn.knn_join(q, r.where("source_id = 's2'"), 10, 0.5).count() == 0


def test_ivf_join(spark, clustered):
    q, r = clustered
    a, b = frames(spark, q, r)
    centres = knn.fit_centres(b, lists=12)
    listed = knn.with_list_id(b, centres)
    assert listed.count() == len(r)
    everything = knn.ivf_join(a, listed, centres, 7, probes=12, chunk_rows=25)
    assert pairs(everything) == brute(q, r, 7)
    few = knn.ivf_join(a, listed, centres, 7, probes=3)
    per_query = few.groupBy("enterprise_id").count().agg(F.max("count")).first()[0]
    assert per_query <= 7
    row = knn.recall_share(few, knn.knn_join(a, b, 7)).first()
    assert row["true_pairs"] == 150 * 7 and row["recall"] > 0.8


def test_list_count_rule():
    assert [knn.auto_lists(n) for n in (10, 100_000, 500_000, 1_000_000, 5_000_000, 100_000_000)] == [100, 100, 500, 1000, 2236, 4000]
    assert [knn.auto_probes(n) for n in (1, 100, 4000)] == [1, 10, 63]


def test_search(spark):
    rng = np.random.default_rng(3)
    r = unit(rng, 50, 8)
    _, b = frames(spark, r[:1], r)
    found = [x["source_id"] for x in knn.search(b, [float(x) for x in r[4]], 3).collect()]
    order = np.argsort(((r.astype(float) - r[4]) ** 2).sum(axis=1))[:3]
    assert found == [f"r{j}" for j in order]


def test_too_many_centres_are_refused():
    with pytest.raises(ValueError):
        knn._check_centres(np.zeros((knn.MAX_CELLS + 1, 1025), dtype=np.int8))


@pytest.mark.parametrize("options", [{}, {"cell_rows": 30, "chunk_rows": 7}, {"cell_rows": 30, "axes": 4}])
def test_what_is_shuffled_does_not_follow_the_rows_compared_at_once(spark, clustered, monkeypatch, options):
    q, r = clustered
    a, b = frames(spark, q, r)
    met = []
    plain = knn._meet
    monkeypatch.setattr(knn, "_meet", lambda *args, **kw: met.append(args) or plain(*args, **kw))
    assert pairs(knn.knn_join(a, b, 7, **options)) == brute(q, r, 7)
    sent, _, reference_rows = met[0][:3]
    assert len(reference_rows) == 1 and sent.count() == len(q)
    # chunks of both sides: no group is larger than a chunk on either
    monkeypatch.setattr(knn, "_chunk_rows", lambda references: 20)
    monkeypatch.setattr(knn, "GROUP_PAIRS", 400)
    assert pairs(knn.knn_join(a, b, 7, **options)) == brute(q, r, 7)
    assert met[1][6] == 20 and (len(met[1][2]) > 1 or not options)


def test_a_chunk_is_bounded_in_pairs(spark, clustered):
    _, b = frames(spark, *clustered)
    assert 1024 <= knn._chunk_rows(b) <= knn.GROUP_PAIRS ** 0.5


@pytest.mark.parametrize("options", [{"cell_rows": 30}, {"cell_rows": 30, "chunk_rows": 7}])
def test_rounds_send_no_more_than_both_sides_hold(spark, clustered, monkeypatch, options):
    q, r = clustered
    a, b = frames(spark, q, r)
    made, kept, left = [], knn._rounds, []
    monkeypatch.setattr(knn, "_chunk_rows", lambda references: 20)
    monkeypatch.setattr(knn, "ROUND_BYTES", 1)
    monkeypatch.setattr(knn, "_rounds", lambda *args: made.append((args, kept(*args))) or made[-1][1])
    monkeypatch.setattr(knn, "discard", lambda spark, path: left.append(path))
    assert pairs(knn.knn_join(a, b, 7, **options)) == brute(q, r, 7)
    (chunks, references, queries, most), rounds = made[0]
    assert len(rounds) > 2 and most <= len(q) + len(r)
    each = {c: queries[c] + -(-references[c] // n) * m for c, (m, n) in chunks.items()}
    assert all(sum(each[p.cell] * (p.last - p.first) for p in x) <= max(most, max(each.values())) for x in rounds)
    assert sum(p.places for x in rounds for p in x) == sum(m * n for m, n in chunks.values())
    # what a round leaves goes, but for the last one's result
    assert sum("/best-" in x for x in left) == len(rounds) - 1 and len(left) == len(rounds) + 1


def test_names_and_addresses_do_not_travel_with_the_vectors(spark, monkeypatch):
    met, plain = [], knn._meet
    monkeypatch.setattr(knn, "_meet", lambda *args, **kw: met.append(args) or plain(*args, **kw))
    v = [[1.0, 0.0], [0.0, 1.0]]
    q = spark.createDataFrame([("1", None, "x", v[0]), ("1", "x", None, v[1]), ("2", "n", "y", v[0]), ("2", "n", "y", v[0]), (None, "n", "z", v[1])], QUERY)
    r = spark.createDataFrame([("s", "c", None, v[0]), ("s", "c", None, v[0]), ("s", None, "c", v[1]), ("t", "d", "", [-1.0, 0.0])], REFERENCE)
    rows = knn.knn_join(q, r, 2, 0.9).collect()
    said = sorted((tuple(x[:6]) for x in rows), key=str)
    assert said == sorted([
        *[("1", None, "x", "s", "c", "")] * 2, ("1", "x", None, "s", None, "c"), *[("2", "n", "y", "s", "c", "")] * 4, (None, "n", "z", "s", None, "c"),
    ], key=str)
    assert not any("address" in c or "name" in c for side in met[0][:2] for c in side.columns)


@pytest.mark.parametrize("probes", [2, 5, 12])
def test_a_query_is_sent_once_to_neighbouring_lists(spark, clustered, monkeypatch, probes):
    q, r = clustered
    a, b = frames(spark, q, r)
    centres = r[[3, 40, 77, 101, 130, 155, 170, 200, 210, 220, 240, 395]].astype(float)
    met, plain = [], knn._meet
    monkeypatch.setattr(knn, "_meet", lambda *args, **kw: met.append(args) or plain(*args, **kw))
    monkeypatch.setattr(knn, "_chunk_rows", lambda references: 150)
    near = knn._squared_distances(r.astype(float), centres).argmin(axis=1)
    filled = np.bincount(near, minlength=12) > 0
    found = pairs(knn.ivf_join(a, knn.with_list_id(b, centres), centres, 4, probes=probes))
    chosen = knn._cells_to_probe(q.astype(float), centres, filled, probes)
    truth = set()
    for i, v in enumerate(q):
        few = np.flatnonzero(chosen[i][near])
        gap = 1 - ((r[few].astype(float) - v) ** 2).sum(axis=1) / 2
        truth |= {(f"q{i}", f"r{few[j]}") for j in sorted(range(len(few)), key=lambda j: (-round(gap[j], 12), f"r{few[j]}"))[:4]}
    assert found == truth
    assert met[0][0].count() < chosen.sum()
