"""Sets, signatures, exact links and groups against comparing all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from addrloom.llm import minhash
from addrloom.llm.keys import within


def plain_set(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain_groups(rows, per_cent=85):
    """Smallest id reachable of every row; rows without a shingle stay alone."""
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= per_cent * len(a | sets[j]) and label[i] != label[j]:
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    ids = {}
    for (key, _), x in zip(rows, label):
        if key is not None:
            ids[x] = min(ids.get(x, key), key)
    return sorted(((k, len(s), k if not s else ids.get(x)) for (k, _), s, x in zip(rows, sets, label)), key=str)


def corpus(seed=11, bases=30, near=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)] + ["É", "ü", "THE", "日本語"]
    out = [None, "", " \n\t", "a", "A", "a b", "A  B", "a b c d", "a b c d e", "x" * 30000]
    for _ in range(bases):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 160))]
        out += [" ".join(w), " ".join(w).upper(), "\t".join(w) + "\n"]
        for _ in range(near):
            w = list(w)  # each a step from the last, so that chains form
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    out.append(" ".join(rng.choice(vocabulary) for _ in range(60000)))
    out.append(out[-1] + " more")
    rows = list(enumerate(out))
    rng.shuffle(rows)
    return rows + [(None, out[20]), (None, "alone and without a name at all"), (3, out[20]), (3, out[20])]


@pytest.mark.parametrize("sizes", [{}, {"chunk_shingles": 400, "chunk_documents": 3}])
def test_groups(spark, sizes):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, **sizes).collect()]
    assert sorted(found, key=str) == plain_groups(rows)


def test_at_the_threshold(spark):
    """17 of 20 shingles count, one less does not."""
    one = [f"a{i}" for i in range(24)]  # 20 shingles
    rows = [(1, " ".join(one)), (2, " ".join(one[:21])), (3, " ".join(one[:20]))]
    out = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # 2 has 17 of 1's 20, 3 has 16 of 1's but 16 of 2's 17
    assert out == {1: (1, True), 2: (1, False), 3: (1, False)}
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame([rows[0], rows[2]], "doc_id long, text string")).collect()}
    assert out == {1: 1, 3: 3}


def test_names_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("b", "one two", 1), ("a", "ONE two", 2), (None, None, 3)], "id string, said string, n int")
    out = minhash.near_duplicates(df.withColumn("c1", df["n"]).withColumnRenamed("n", "buckets"), "id", "said")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("b", 1, "a", False), ("a", 1, "a", True), (None, 0, None, True)], key=str)
    assert minhash.near_duplicates(df.limit(0), "id", "said").collect() == []


def test_the_second_permutation_is_shifted():
    """Coordinate k of a set is coordinate 0 of the set moved by k."""
    hashes = np.random.default_rng(0).integers(0, 2**63, 50, dtype=np.uint64)
    spread = (hashes >> np.uint64(32)).astype(np.uint32)
    scratch = np.empty_like(spread)
    minhash._permute(spread, scratch, 0x7FEB352D, 0x846CA68B)
    out = minhash.signatures(hashes, np.array([0]), 20)
    for k in range(20):
        moved = spread - np.uint32(k)
        minhash._permute(moved, scratch, 0x85EBCA6B, 0xC2B2AE35)
        assert out[k, 0] == moved.min()


def test_permutation():
    x = np.arange(1 << 20, dtype=np.uint32) * np.uint32(4093)
    minhash._permute(x, np.empty_like(x), 0x85EBCA6B, 0xC2B2AE35)
    assert len(np.unique(x)) == 1 << 20


def test_signatures_estimate():
    rng = np.random.default_rng(5)
    universe = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)
    for share in (300, 200):  # similarities 300 / 400 and so on
        a, b = np.sort(universe[:share]), np.sort(universe)
        both = minhash.signatures(np.concatenate((a, b)), np.array([0, len(a)]), 2000)
        assert abs((both[:, 0] == both[:, 1]).mean() - share / 400) < 0.05


def test_within_keeps_all_wanted(spark):
    rows = spark.range(20000).selectExpr("id as k", "id * 3 as v")
    out = within(rows, spark.range(0, 20000, 100).toDF("k"), "k")
    kept = {r["k"] for r in out.collect()}
    assert out.columns == rows.columns and set(range(0, 20000, 100)) <= kept and len(kept) < 3000
    assert within(rows, spark.range(0).toDF("k"), "k").count() == 0
