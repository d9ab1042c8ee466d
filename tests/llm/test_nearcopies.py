"""Near copies against comparing the five-word shingles of all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from test_simhash import roots

from addrloom.llm import nearcopies


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(texts, per_cent=80):
    """Pairs of numbers of texts that are linked; texts without words are copies."""
    sets = [plain_set(t) for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and 100 * len(a & b) >= per_cent * len(a | b)):
                yield j, i


def texts():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(4000)] + ["É", "THE", "漢字"]
    out = [None, "", " \n", "a", "A", "a b", "a b c d e", "x" * 30000]
    for _ in range(50):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 400))]
        out += [" ".join(w), " ".join(w).upper(), "\t".join(w)]
        for changes in (1, 2, 3, 12):
            v = list(w)
            for _ in range(changes):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            out.append(" ".join(v))
        rng.shuffle(w)  # the same words, other shingles
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard": 16, "chunk": 9}, {"tree": 0}])
def test_one_of_each_group_stays(spark, sizes):
    rows = list(enumerate(texts(), 3))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, root int, c1 string").repartition(3)
    out = nearcopies.deduplicate(df, **sizes)
    group = roots(alike([t for _, t in rows]), range(len(rows)))
    assert out.columns == df.columns
    got, want = {r["doc_id"] for r in out.collect()}, {rows[k][0] for k in set(group.values())}
    # nothing else goes, and nearly all that should go does
    assert out.count() == len(got) and want <= got
    assert len(got - want) <= 0.01 * (len(rows) - len(want))


def test_stars_join_what_all_pairs_join():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    flips = np.array([0, 0, 1, 7, 127, 255, 1 << 40])
    f = (base[:, None] ^ flips[None, :]).ravel()
    key = f & nearcopies.masks(7, 2)[-1]
    v1, v2 = rng.integers(-(1 << 5), 1 << 5, len(f)), np.zeros(len(f), np.int64)
    own = rng.integers(0, 3, len(f))
    for one, two in ((own >= 0, own >= 0), (own == 0, own == 1), (own == 0, own > 5)):
        u, v = nearcopies.near_stars(key, f, v1, v2, one, two, 7, 3)
        want = [
            (i, j) for i in np.flatnonzero(one) for j in np.flatnonzero(two)
            if key[i] == key[j] and int(f[i] ^ f[j]).bit_count() <= 7 and (int(v1[i] ^ v1[j]) % 2**64).bit_count() <= 3
        ]
        assert roots(zip(u.tolist(), v.tolist()), range(len(f))) == roots(want, range(len(f)))


def test_tables_hold_every_near_pair():
    rng = random.Random(5)
    for radius, extra in ((7, 2), (7, 3), (3, 4)):
        masks = nearcopies.masks(radius, extra)
        for _ in range(200):
            a = rng.getrandbits(63)
            b = a
            for k in rng.sample(range(63), radius):
                b ^= 1 << k
            assert any(a & m == b & m for m in masks)
    assert [nearcopies.blocks_chosen(n, 7, 1024) for n in (0, 10**6, 10**8, 10**9, 10**12)] == [2, 2, 3, 4, 4]


def test_repeated_ids_nulls_and_empty_tables(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one, "a"), (1, two, "b"), (2, two + " end", "c"), (3, "other", "d"), (3, "other", "d"), (None, one, "e"), (None, None, "f"), (5, None, "g"), (6, " ", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t1 string").repartition(3)
    out = sorted(map(tuple, nearcopies.deduplicate(df).collect()), key=str)
    assert out == sorted([(1, one, "a"), (1, two, "b"), (3, "other", "d"), (None, one, "e"), (None, None, "f"), (5, None, "g")], key=str)
    assert nearcopies.deduplicate(df.limit(0)).collect() == []
