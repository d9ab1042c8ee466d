"""The recurrent network: gradients, batching, and held-out accuracy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from addrloom.llm import langid

SMALL = "/root/testdata/sf0.01/documents.parquet"


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid.init(3, 4).items()}
    ids, target, weight = rng.integers(97, 101, (5, 6)), rng.integers(0, 3, 5), rng.random(5)
    _, grads = langid.gradients(p, ids, target, weight)
    for name, values in p.items():
        for _ in range(6):
            at = tuple(int(rng.integers(0, n)) for n in values.shape)
            at = (int(rng.integers(97, 101)), at[1]) if name.endswith("_in") else at
            kept, slope = values[at], []
            for step in (1e-3, -1e-3):
                values[at] = kept + step
                slope.append(langid.gradients(p, ids, target, weight)[0])
            values[at] = kept
            assert abs((slope[0] - slope[1]) / 2e-3 - grads[name][at]) < 1e-4, name


def plain_probabilities(p, word):
    """One word, one byte at a time."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    states = {}
    for d, order in (("fwd", range(len(word))), ("bwd", range(len(word) - 1, -1, -1))):
        hidden = p[f"{d}_cand"].shape[0]
        h = np.zeros(hidden)
        for t in order:
            x = p[f"{d}_in"][word[t]].astype(float)
            gates = sigmoid(x[: 2 * hidden] + h @ p[f"{d}_gates"])
            cand = np.tanh(x[2 * hidden :] + (gates[hidden:] * h) @ p[f"{d}_cand"])
            h = (1 - gates[:hidden]) * h + gates[:hidden] * cand
            states[d, t] = h
    out = []
    for t in range(len(word)):
        e = np.exp(states["fwd", t] @ p["fwd_out"] + states["bwd", t] @ p["bwd_out"] + p["out_bias"])
        out.append(e / e.sum())
    return np.array(out)


def plain_document(p, text):
    said = "".join(c.lower() if c.isascii() else c for c in text).encode()
    runs, run = [], b""
    for b in said + b" ":
        if b >= 0x80 or 0x61 <= b <= 0x7A:
            run += bytes([b])
        elif run:
            runs += [run[i : i + langid.SEGMENT] for i in range(0, len(run), langid.SEGMENT)]
            run = b""
    probs = [plain_probabilities(p, r) for r in runs]
    return np.concatenate(probs).mean(axis=0) if probs else None


TEXTS = [None, "", "123 !?", "—…", "Hello wörld", "hello HELLO hello", "é", "a" * 200, "日本語", "x1y2z3", "the " * 3000, "Ünd dann—so"]


def test_documents_on_spark(spark, monkeypatch):
    p = langid.init(3, 5, seed=4)
    model = langid.Model(("aa", "bb", "cc"), p)
    df = spark.createDataFrame([(i, t, "l", 0.5) for i, t in enumerate(TEXTS)] + [(None, "é", None, None)] * 2, "doc_id long, text string, lang_pred string, score double")
    got = langid.predict(df, model, ("doc_id", "score")).select("document.doc_id", "lang_pred", "score").collect()
    assert len(got) == len(TEXTS) + 2
    for r in got[: len(TEXTS)]:
        text = TEXTS[r["doc_id"]]
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            want = plain_document(p, text)
            assert r["lang_pred"] == model.languages[want.argmax()] and abs(r["score"] - want.max()) < 1e-4
    assert langid.predict(df.limit(0), model).count() == 0


def test_memory_starts_over(monkeypatch):
    monkeypatch.setattr(langid, "MEMORY", 3)
    p = langid.init(2, 3)
    labeller = langid._Labeller(p, 2)
    for text in ["ab cd ef gh", "ab zz", "cd", "zz ab xy"]:
        data = np.frombuffer(text.encode(), np.uint8)
        sums, n = labeller.document_sums(data, np.array([0, len(data)]))
        assert np.allclose(sums[0] / n[0], plain_document(p, text), atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SMALL)
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~out))
    found = langid.predict(docs.where(out), model, ("doc_id", "lang")).select(
        F.avg((F.col("document.lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")
    ).first()
    assert found["right"] >= 0.97 and 0 <= found["low"] <= found["high"] <= 1


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "en"), (None, "1", "xx")], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.languages == ()
    assert {r["lang_pred"] for r in langid.predict(df, model).collect()} == {"und"}
    assert df.where(langid.held_out(F.col("doc_id")).isNull()).count() == 0


def test_none_of_the_languages(spark):
    docs = spark.read.parquet(SMALL)
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~out & F.col("lang").isin("en", "de")))
    rng = np.random.default_rng(1)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(60)]
    planted = [(1, "Это предложение на другом языке, и ещё одно"), (2, "これは日本語の文章です"), (3, " ".join(noise))]
    rows = spark.createDataFrame(planted, "doc_id long, text string")
    assert {r["lang_pred"] for r in langid.predict(rows, model, reject=True).collect()} == {langid.UNKNOWN}
    clean = docs.where(out & F.col("lang").isin("en", "de") & (F.col("n_chars") > 100))
    lost = langid.predict(clean, model, reject=True).where(F.col("lang_pred") == langid.UNKNOWN).count()
    assert len(model.languages) == 2 and lost <= 0.01 * clean.count()
