"""The chain's marginals against all tag sequences, and what is learned from a planted vocabulary."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from addrloom.llm import toxicity
from addrloom.llm.letters import PartHashes


def test_marginals_and_expectations():
    rng = np.random.default_rng(2)
    size = np.array([3, 1, 5, 2])
    first = np.cumsum(size) - size
    score, trans, begin = rng.normal(size=11), rng.normal(size=(2, 2)), rng.normal(size=2)
    p, steps, starts = toxicity.marginals(score, first, size, trans, begin, expect=True)
    want, want_steps, want_starts = np.zeros(11), np.zeros((2, 2)), np.zeros(2)
    for a, n in zip(first, size):
        paths = list(itertools.product((0, 1), repeat=n))
        weight = np.array([np.exp(begin[t[0]] + sum(score[a + i] * t[i] for i in range(n)) + sum(trans[t[i], t[i + 1]] for i in range(n - 1))) for t in paths])
        for t, w in zip(paths, weight / weight.sum()):
            want[a : a + n] += w * np.array(t)
            want_starts[t[0]] += w
            for i in range(n - 1):
                want_steps[t[i], t[i + 1]] += w
    assert np.allclose(p, want) and np.allclose(steps, want_steps) and np.allclose(starts, want_starts)
    assert len(toxicity.marginals(score[:0], first[:0], size[:0], trans, begin)) == 0


def test_words_and_sentences():
    texts = ["One two. Three\nfour", "", "é 1 b!c", "d"]
    data = [t.encode() for t in texts]
    w = toxicity.Words(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))), PartHashes())
    assert w.row.tolist() == [0, 0, 0, 0, 2, 2, 2, 3] and w.size.tolist() == [2, 1, 1, 2, 1, 1]
    assert (w.features[:, 0] > 0).all() and (w.features[4, 1:] == 0).all()


@pytest.fixture(scope="module")
def corpus():
    """Toxic texts have a few of ten bad words or of words with a bad beginning, which varies."""
    rng = random.Random(6)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))
    bad = [f"zob{c}rk" for c in "aeiou"] + [f"gru{c}x" for c in "aeiou"]
    rows = []
    for i in range(1500):
        said = [word() for _ in range(rng.randrange(5, 80))]
        toxic = i % 6 == 0
        for _ in range(rng.randrange(1, 6) if toxic else 0):
            said.insert(rng.randrange(len(said)), rng.choice(bad) if rng.random() < 0.5 else "vekku" + word())
        rows.append((i, " ".join(said[:10]) + ". " + " ".join(said[10:]), int(toxic)))
    return rows


def test_learned_on_spark(spark, corpus):
    df = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in corpus] + [(None, 1), (5000, None), (6000, 1)], "doc_id long, toxic int")
    taught = toxicity.F.col("doc_id") % 3 != 1
    model = toxicity.fit(df.where(taught), labels.where(taught))
    new = [(9001, "hand ander vekkuquite ready"), (9002, "hand ander ready"), (9003, None), (9004, ""), (9005, "42 !"), (9006, "reon " * 30000 + "é zobark")]
    both = df.unionByName(spark.createDataFrame(new, df.schema))
    got = {r["doc_id"]: r for r in toxicity.score(both, model).select("document.doc_id", "score", "n_toxic", "spans").collect()}
    held = [(got[i]["score"] >= toxicity.THRESHOLD, bool(x)) for i, _, x in corpus if i % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert got[9001]["score"] > 0.7 and [tuple(s) for s in got[9001]["spans"]] == [(11, 21)]
    assert got[9002]["score"] < 0.3 and got[9002]["spans"] == []
    assert got[9003]["score"] == got[9004]["score"] == got[9005]["score"] < 0.3
    assert [tuple(s) for s in got[9006]["spans"]] == [(150002, 150008)]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_without_labels_nulls_and_names(spark):
    df = spark.createDataFrame([(1, "a", 5.0, "s"), (None, None, None, None), (1, "a", 5.0, "s")], "doc_id long, text string, score double, spans string")
    none = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.fit(df, none) is None and toxicity.fit(df, none.limit(0)) is None
    got = toxicity.score(df, None, ("doc_id", "score", "spans")).select("document.doc_id", "score").collect()
    assert [r["score"] for r in got] == [0.0] * 3
    assert toxicity.score(df.limit(0), None).count() == 0
