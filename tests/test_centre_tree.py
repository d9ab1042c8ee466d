from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_knn import QUERY, REFERENCE, brute, frames, pairs, unit

from addrloom.operators import centre_tree, knn
from addrloom.operators.centre_tree import CentreTree
from addrloom.plans import match, vectorize
from addrloom.sources import tables


@pytest.fixture(scope="module")
def clustered():
    """40 clusters, one with a third of all rows; a tenth of the rows are copies of one vector."""
    rng = np.random.default_rng(11)
    centres = unit(rng, 40, 12)
    where = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 40, 3000))
    r = centres[where] + 0.08 * rng.normal(size=(3000, 12))
    r = (r / np.linalg.norm(r, axis=1, keepdims=True)).astype(np.float32)
    r[2000:2300] = r[2000]
    q = r[rng.integers(0, 3000, 120)] + 0.03 * rng.normal(size=(120, 12))
    return (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32), r


def plain_probe(tree, point, filled, probes):
    """The search of a tree, node by node."""
    children = {}
    for node, p in enumerate(tree.parent.tolist()):
        children.setdefault(p, []).append(node)

    def lists_below(node):
        below = children.get(node)
        return sum(map(lists_below, below)) if below else int(filled[tree.list_of[node]])

    def gap(node):
        return float(((point.astype(float) - tree.centres[node].astype(float)) ** 2).sum())

    level = [n for n in children[-1] if lists_below(n)]
    while True:
        kept, before = [], 0
        for n in sorted(level, key=lambda n: (gap(n), n)):
            if before < centre_tree.WIDEN * probes:
                kept.append(n)
            before += lists_below(n)
        if all(n not in children for n in kept):
            return [int(tree.list_of[n]) for n in sorted(kept, key=lambda n: (gap(n), n))[:probes]]
        level = [c for n in kept for c in children.get(n, [n]) if lists_below(c)]


def test_fitted_tree_keeps_recall_and_splits_hot_lists(spark, clustered):
    q, r = clustered
    a, b = frames(spark, q, r)
    truth = brute(q, r, 5)
    flat = knn.fit_centres(b, 60)
    tree = centre_tree.fit_tree(b, 60, branching=8)
    assert 40 <= len(tree) <= 120 and (np.diff(tree.first) >= 0).all()
    assert (tree.last - tree.first).max() <= 8
    found = pairs(knn.ivf_join(a, knn.with_list_id(b, tree), tree, 5, probes=8))
    flat_found = pairs(knn.ivf_join(a, knn.with_list_id(b, flat), flat, 5, probes=8))
    assert len(found & truth) >= 0.95 * len(flat_found & truth)
    assert pairs(knn.ivf_join(a, knn.with_list_id(b, tree), tree, 5, probes=len(tree))) == truth
    # the dense cluster is many lists; no list has far more different vectors than its share
    sizes = knn.with_list_id(b, tree).groupBy("list_id").agg(F.countDistinct("vector").alias("n")).collect()
    share = len(np.unique(r, axis=0)) / 60
    assert max(x["n"] for x in sizes) <= centre_tree.HOT * share + 1


def test_search_is_the_plain_one(clustered):
    q, r = clustered
    rng = np.random.default_rng(3)
    parent = np.array([-1] * 5 + [0] * 3 + [1] * 4 + [3] * 2 + [6] * 3)
    tree = CentreTree(r[rng.choice(1900, len(parent), replace=False)], parent)
    assert len(tree) == 2 + 2 + 4 + 2 + 3  # two leaves at the top, one inner node below the first
    filled = rng.random(len(tree)) < 0.7
    for probes in (1, 2, 5, 20):
        row, at = tree.search(filled, probes)(q.astype(np.float64))
        for i, point in enumerate(q):
            assert at[row == i].tolist() == plain_probe(tree, point, filled, probes)
    node_lists, squared = tree.nearest(r[:200].astype(np.float64))
    assert (node_lists < len(tree)).all() and (squared >= 0).all()


def test_wrong_trees_and_sizes(spark, clustered):
    _, r = clustered
    with pytest.raises(ValueError, match="children must follow"):
        CentreTree(r[:3], np.array([-1, 2, -1]))
    with pytest.raises(ValueError, match="too many"):
        CentreTree(np.zeros((centre_tree.MAX_TREE_NUMBERS // 8 + 1, 8), dtype=np.float32), np.full(centre_tree.MAX_TREE_NUMBERS // 8 + 1, -1))
    with pytest.raises(ValueError, match="no vectors"):
        centre_tree.fit_tree(spark.createDataFrame([("a", "b", "c", None)], REFERENCE))
    some = spark.createDataFrame([("a", "b", "c", [1.0, 0.0])], REFERENCE)
    with pytest.raises(ValueError, match="at most"):
        centre_tree.fit_tree(some, centre_tree.MAX_TREE_NUMBERS)
    with pytest.raises(ValueError, match="children"):
        centre_tree.fit_tree(some, 4, branching=1)


def test_copies_alone_and_one_row(spark):
    """Equal vectors cannot be split: one list, found by any search."""
    copies = spark.createDataFrame([(f"r{i}", "b", "1", [0.6, 0.8]) for i in range(50)], REFERENCE)
    queries = spark.createDataFrame([("q", "n", "a", [1.0, 0.0])], QUERY)
    for rows in (copies, copies.limit(1)):
        tree = centre_tree.fit_tree(rows, 10)
        assert len(tree) == 1
        assert knn.ivf_join(queries, knn.with_list_id(rows, tree), tree, 3).count() == min(3, rows.count())


def test_stored_index_with_a_tree(spark, clustered, tmp_path):
    q, r = clustered
    a, b = frames(spark, q, r)
    queries, index = str(tmp_path / "q"), str(tmp_path / "r")
    tables.replace(tables.vector_rows(a, "enterprise"), queries)
    vectorize.index(tables.vector_rows(b, "standard"), index, 50, tree=True)
    tree = knn.load_centres(spark, vectorize.centres_path(index))
    assert isinstance(tree, CentreTree) and len(tree) > 20
    match.run_recall(spark, queries, index, str(tmp_path / "found"), 5, probes=len(tree))
    assert pairs(spark.read.parquet(str(tmp_path / "found"))) == brute(q, r, 5)
    # arriving rows go down the same tree
    published = str(tmp_path / "p")
    vectorize.publish(tables.vector_rows(b, "standard"), published, centres=tree)
    again = knn.load_centres(spark, vectorize.centres_path(published))
    assert np.array_equal(again.centres, tree.centres) and np.array_equal(again.parent, tree.parent)
