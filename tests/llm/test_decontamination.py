"""Window hits against looking every window up in plain Python."""

from __future__ import annotations

import random
import re

import pytest

from addrloom.llm import decontamination as dc

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1) if w and item is not None else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if names := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= names
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def tables(spark):
    rng = random.Random(4)
    vocabulary = ["Aa", "bB", "çé", "42", "ߟ", "x", "the", "of"]
    said = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, said(rng.randrange(1, 40))) for i in range(12)] + [(20, said(10)), (21, None), (22, ""), (None, said(12)), (23, "x the of"), (23, "unseen words only here")]
    docs = [(i, said(rng.randrange(0, 80))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "!!"), (103, items[5][1].upper()), (104, f"pré, {items[12][1].replace(' ', ' -- ')} 𝒳 post"), (None, items[3][1]), (103, items[5][1])]
    docs += [(105, said(5000)), (106, "ab" * 40000)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [dc.BLOCK_BYTES, 300])
def test_hits(spark, block_bytes):
    docs, items = tables(spark)
    df = spark.createDataFrame([(d, t, "s", "i", 3) for d, t in docs], "doc_id long, text string, spans string, items string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.scan(df, bench, ("doc_id", "spans"), block_bytes=block_bytes).select(
        "document.doc_id", "n_words", dc.hit_words(dc.F.col("spans")).alias("n"), "items"
    ).collect()
    key = lambda r: str(r)
    assert sorted([(r["doc_id"], r["n_words"], r["n"], r["items"]) for r in got], key=key) == sorted(plain(docs, items), key=key)


def test_removal(spark):
    docs, items = tables(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    hit = {d: n for d, _, n, _ in plain(docs, items)}
    kept = dc.decontaminate(df, bench).collect()
    assert {r["doc_id"] for r in kept} == {d for d, n in hit.items() if n == 0} and 100 in {r["doc_id"] for r in kept}
    cut = dc.decontaminate(df, bench, remove="spans").collect()
    assert len(cut) == len(docs)
    left = {r["doc_id"]: r["text"] for r in cut}
    assert left[104].startswith("pré, ") and left[104].endswith(" 𝒳 post") and left[100] is None
    for doc, text in docs:
        if hit[doc] == 0:
            assert left[doc] == text
        elif doc in (103, 104):
            assert len(words(left[doc])) == len(words(text)) - hit[doc]
    with pytest.raises(ValueError):
        dc.decontaminate(df, bench, remove="all")


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.scan(docs.limit(0), bench).count() == 0
    assert dc.decontaminate(docs, bench.limit(0)).count() == 1
