"""Fingerprints, trees and groups against comparing all pairs."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash

from addrloom.llm import simhash
from addrloom.llm.components import components


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    said = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in said]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_pairs(values, radius):
    values = np.asarray(values, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius):
            yield i, i + 1 + int(j)


def texts():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ü", "\x0b", "THE"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 150))) for _ in range(40)]
    out = [None, "", " \n", "a", "A", "a b", "A  B", "a b c", "x" * 30000]
    for b in base:
        w = b.split(" ")
        out += [b, b.upper(), b.replace(" ", "\t")]
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = rng.choice(vocabulary)
            out.append(" ".join(v))
    return out


@pytest.mark.parametrize("radius, sizes", [(3, {}), (3, {"shard": 8, "chunk": 5}), (0, {}), (7, {"chunk": 16})])
def test_groups(spark, radius, sizes):
    rows = list(enumerate(texts(), 5))
    rows += [(None, rows[20][1]), (None, "only this null id says so"), (5, None)]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, fingerprint string, component_id int, id string")
    got = simhash.near_duplicates(df, radius=radius, **sizes).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    group = roots(near_pairs(prints, radius), range(len(rows)))
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[group[k]] = min(i, smallest.get(group[k], i))
    want = sorted((str(i), f"{prints[k]:016x}", str(smallest.get(group[k]))) for k, (i, _) in enumerate(rows))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, 50, dtype=np.uint64)
    values = np.unique(np.concatenate([values ^ np.uint64(f) for f in (0, 1, 7, 1 << 40, 3 << 20, (1 << 63) | 5)]))
    for radius in (0, 1, 3, 10, 64):
        q, m = simhash.Tree(values).near(values, radius)
        want = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
        assert len(q) == want.sum() and want[q, m].all()
    assert len(simhash.Tree(values[:0]).near(values, 3)[0]) == 0
    assert sorted(simhash.Tree(values).member) == list(range(len(values)))


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(300)]
    pairs = chain + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(60)] + [(5000, x) for x in range(5001, 5200)] + [(-3, 4000), (7, 7)]
    df = spark.createDataFrame(pairs + [(None, 1), (1, None), (0, 1), (1, 0)], "u long, v long").repartition(5)
    got = {r["node"]: r["root"] for r in components(df).collect()}
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == {k: v for k, v in roots(pairs, {n for p in pairs for n in p}).items() if k in nodes}
    assert components(df.limit(0)).count() == 0


def test_deduplicate(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "k") for i, t in rows] + [(3, "a", "k"), (None, "a", "k")], "doc_id long, text string, kept string")
    got = simhash.deduplicate(df).collect()
    group = roots(near_pairs([plain_fingerprint(t) for _, t in rows], 3), range(len(rows)))
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(set(group.values()))
    assert sum(r["doc_id"] is None for r in got) == 1 and got[0].__fields__ == df.columns


def test_empty_and_bounds(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(df.selectExpr("doc_id as fingerprint"), 8)


def test_deduplicate_loses_no_group(spark):
    one, two, three = "alpha beta gamma delta epsilon", "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, one, "a"), (1, two, "b"), (2, two, "c"), (3, three, "d"), (3, three, "d"), (4, three, "e"), (None, one, "f"), (None, None, "g"), (5, None, "h"), (6, "", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t1 string").repartition(3)
    out = sorted(map(tuple, simhash.deduplicate(df).collect()), key=str)
    assert out == sorted([(1, one, "a"), (1, two, "b"), (3, three, "d"), (None, one, "f"), (None, None, "g"), (5, None, "h")], key=str)
    assert simhash.deduplicate(df).columns == df.columns and simhash.deduplicate(df.limit(0)).collect() == []


def test_deduplicate_keeps_one_of_each_group(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    groups = simhash.near_duplicates(df).collect()
    assert {r["doc_id"] for r in simhash.deduplicate(df).collect()} == {r["component_id"] for r in groups}


def test_a_search_among_near_values_holds_a_bounded_number_of_pairs():
    # 8,192 values within 7 bits of one another: all of them are near every query
    base = np.uint64(0x0123456789ABCDEF)
    values = base ^ (np.arange(128, dtype=np.uint64)[:, None] << np.uint64(20) | np.arange(64, dtype=np.uint64)).reshape(-1)
    tree = simhash.Tree(values)
    asked = values[:512]
    tracemalloc.start()
    sizes = [len(q) for q, _ in tree.near_parts(asked, 13)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == len(values) * len(asked) and max(sizes) < 1 << 18
    assert peak < 40 << 20, peak
