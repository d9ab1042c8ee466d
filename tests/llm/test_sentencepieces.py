"""Batched segmentation against the plain recursion and the exact round trip."""

from __future__ import annotations

import random

import numpy as np
import pytest

from addrloom.llm import sentencepieces as sp

PATH = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return sp.load(PATH)


def plain(vocabulary, text):
    """Best segmentation of a whole text by trying every piece at every position; the longest last piece first."""
    by_text = {p[0]: (i, p[1]) for i, p in enumerate(vocabulary.pieces) if p}
    unknown = min(p[1] for p in vocabulary.pieces if p) - sp.UNKNOWN_PENALTY
    chars = [sp.LITERAL if c == "▁" else "▁" if c == " " else c for c in " " + text]
    longest = max(map(len, by_text))
    best = [(0.0, [])] + [None] * len(chars)
    for end in range(1, len(chars) + 1):
        for size in range(min(longest, end), 0, -1):
            part = chars[end - size : end]
            score, ids = None, None
            if sp.LITERAL not in part and "".join(part) in by_text:
                i, score = by_text["".join(part)]
                ids = [i]
            elif size == 1:
                said = ("▁" if part[0] == sp.LITERAL else part[0]).encode()
                score, ids = unknown, [vocabulary.byte_ids[b] for b in said]
            if score is not None and (best[end] is None or best[end - size][0] + score > best[end][0]):
                best[end] = (best[end - size][0] + score, best[end - size][1] + ids)
    return best[-1]


TEXTS = [
    "a", " ", "   ", " a  b ", "Hello wörld", "\n", "a\n\nb\t", "𝒳𝒴 é", "▁", " ▁ ▁a", "<s> </s> <unk> <0x41>", "0123456789" * 3,
    "thelongestwordthatnobodysays" * 4, "日本語のテキスト", "é", "x" * 70, "\x00\x01", "Ofthtioninor. Geieen ererie; ciónqueco!",
]


def score(vocabulary, ids):
    unknown = min(p[1] for p in vocabulary.pieces if p) - sp.UNKNOWN_PENALTY
    return sum(vocabulary.pieces[i][1] for i in ids if vocabulary.pieces[i]), unknown


def test_best_segmentation(vocabulary):
    rng = random.Random(1)
    alphabet = ["the", "er", "ing", " ", "  ", "é", "ó", "\n", "q", "zz", "ß", "𝒳", ".", "▁", "tion"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    encoder = sp.Encoder(sp.tables(vocabulary))
    for some in (texts, texts[::-1], [None, "", *texts[:5], None, ""]):
        ids, at = encoder.encode(some)
        for i, text in enumerate(some):
            got = ids[at[i] : at[i + 1]].tolist()
            want = plain(vocabulary, text) if text else (0.0, [])
            if got != want[1]:  # another path of the same score
                assert len([x for x in got if not vocabulary.pieces[x]]) == len([x for x in want[1] if not vocabulary.pieces[x]])
                assert abs(score(vocabulary, got)[0] - score(vocabulary, want[1])[0]) < 1e-6, text


def test_memory_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(sp, "MEMORY", 4)
    encoder = sp.Encoder(sp.tables(vocabulary))
    for text in ["one two three four five six", "seven eight", "one nine"]:
        ids, _ = encoder.encode([text])
        assert ids.tolist() == plain(vocabulary, text)[1]


def test_agrees_with_a_likelihood_vocabulary():
    """A small vocabulary with log probabilities, worked by hand."""
    pieces = [None, ("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -4.0), ("▁a", -2.2), ("▁ab", -4.6)] + [None] * 256
    v = sp.Vocabulary(tuple(pieces), tuple(range(7, 263)), tuple([b""] * 263))
    ids, _ = sp.Encoder(sp.tables(v)).encode(["ab"])
    assert ids.tolist() == [6]  # -4.6 against -4.7 and -7
    ids, _ = sp.Encoder(sp.tables(v)).encode(["abab"])
    assert ids.tolist() == [6, 4]


def test_round_trip_on_spark(spark, vocabulary):
    rows = [(i, t, "n", "z") for i, t in enumerate([None, "", *TEXTS, "many words " * 20000, "y" * 60000])] + [(0, "dup", None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, row string")
    out = sp.encode(df, vocabulary, ("doc_id", "text", "ids", "row"), check=True)
    got = out.select("document.doc_id", "ids", "exact", "document.text").collect()
    assert len(got) == len(rows) and all(r["exact"] if r["text"] is not None else r["exact"] is None and r["ids"] is None for r in got)
    assert [r["ids"] for r in got if r["text"] == ""] == [[]]
    back = sp.decode(out.select("ids", "document.text"), vocabulary, text_column="said").collect()
    assert all(r["said"] == r["text"] for r in back)
    assert sp.encode(df.limit(0), vocabulary).count() == 0


def test_odd_ids(vocabulary):
    said = list(vocabulary.said)
    assert sp.decode_ids(said, [1, 2, None, -5, 10**7, 0]) == "�" * 4
    assert sp.decode_ids(said, [vocabulary.byte_ids[0xE2], vocabulary.byte_ids[0x41]]) == "�A"
    assert sp.decode_ids(said, []) == ""


def test_keys_are_distinct(vocabulary):
    keys = sp.tables(vocabulary)["keys"]
    assert len(np.unique(keys)) == len(keys) == sum(p is not None for p in vocabulary.pieces)
