"""Every stage of the pipeline against its plain version, on its own input."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline as pipeline  # noqa: E402
from addrloom.llm import langid  # noqa: E402
from test_decontamination import plain as plain_hits  # noqa: E402
from test_langid import plain_document  # noqa: E402
from test_nearcopies import alike  # noqa: E402
from test_pii import plain_spans  # noqa: E402
from test_sentencepieces import plain as plain_pieces  # noqa: E402
from test_simhash import roots  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """Short documents of the smallest table, and planted ones; nulls in every column."""
    real = spark.read.parquet(f"{FOLDER}/documents.parquet")
    short = real.where("n_chars < 500").orderBy("doc_id").limit(60)
    texts = {r["doc_id"]: r["text"] for r in short.collect()}
    first = next(t for t in texts.values() if len(t) > 200)
    leak = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first()["text"]
    planted = [
        (9001, "0123 456 !!", "en", "a"), (9002, None, "de", "a"), (9003, "", None, None), (9004, first, "en", "b"), (9005, first + " ", None, "b"),
        (9006, "Of the and in that " + leak + " to the end", "en", "c"), (9007, "And the mail is Me.You@Example.com or 10.20.30.40 and the end of it", "en", "c"),
        (9008, "The number is +1 (988) 555-2485 and 4111 1111 1111 1111 for that", "en", "d"), (None, "The and of the row without an id", "en", "e"),
        (None, "The and of the row without an id", "en", "e"), (9009, "The same row of the and twice", "en", "f"), (9009, "The same row of the and twice", "en", "f"),
    ]
    more = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in planted], real.schema)
    return short.unionByName(more)


@pytest.fixture(scope="module")
def stages(spark, docs):
    """Input and output rows of every stage."""
    out, here = {}, docs
    for name, stage in pipeline.STAGES:
        done = pipeline.stored(stage(spark, here, FOLDER), name)
        out[name] = ([tuple(r) for r in here.collect()], [tuple(r) for r in done.collect()], done.columns)
        here = done
    return out


def key(row):
    return str(row)


def test_columns(docs, stages):
    for name, (_, _, columns) in list(stages.items())[:-1]:
        assert columns == docs.columns, name


def test_language(spark, docs, stages):
    before, after, _ = stages["language"]
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    want = []
    for row in before:
        probs = plain_document(model.params, row[1]) if row[1] and any(c.isalpha() for c in row[1]) else None
        if probs is not None and probs.max() >= pipeline.MIN_LANGUAGE_SCORE:
            want.append(row)
    assert sorted(after, key=key) == sorted(want, key=key)
    assert {9001, 9002, 9003}.isdisjoint({r[0] for r in after}) and {9004, 9007} <= {r[0] for r in after}


def test_near_duplicates(stages):
    before, after, _ = stages["near_duplicates"]
    named = [r for r in dict.fromkeys(before) if r[0] is not None]
    group = roots(alike([r[1] for r in named]), range(len(named)))
    smallest = {}
    for k, r in enumerate(named):
        smallest[group[k]] = min(r[0], smallest.get(group[k], r[0]))
    kept = [r for k, r in enumerate(named) if smallest[group[k]] == r[0]] + [r for r in before if r[0] is None]
    assert sorted(after, key=key) == sorted(kept, key=key)
    assert 9004 not in {r[0] for r in after} or 9005 not in {r[0] for r in after}


def test_decontaminated(spark, stages):
    before, after, _ = stages["decontaminated"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hits = plain_hits([(k, r[1]) for k, r in enumerate(before)], items)
    assert sorted(after, key=key) == sorted((r for r, h in zip(before, hits) if h[2] == 0), key=key)
    assert 9006 not in {r[0] for r in after}


def test_sanitised(stages):
    before, after, _ = stages["sanitised"]
    assert len(after) == len(before)
    done = {r[0]: r for r in after}
    for row in before:
        if not plain_spans(row[1]) and row[0] is not None:
            assert done[row[0]] == row
    assert done[9007][1] == "And the mail is [EMAIL] or [IP] and the end of it"
    assert done[9008][1] == "The number is [PHONE] and [CARD] for that" and done[9008][4] == len(done[9008][1])
    assert not any(re.search(r"@\w+\.|\+\d", r[1]) for r in after)


def test_tokens(stages):
    before, after, columns = stages["tokens"]
    assert columns == ["doc_id", "lang", "source", "n_tokens", "round_trip", "ids"] and len(after) == len(before)
    vocabulary = pipeline.sentencepieces.load(pipeline.VOCABULARY)
    assert all(r[4] and r[3] == len(r[5]) for r in after)
    said = {r[0]: r[1] for r in before}
    for r in sorted(after, key=key)[::8]:
        if r[0] is not None:
            want = plain_pieces(vocabulary, said[r[0]])[1]
            score = lambda ids: sum(vocabulary.pieces[i][1] for i in ids if vocabulary.pieces[i])
            assert r[5] == want or abs(score(r[5]) - score(want)) < 1e-6


def test_run_and_empty(spark, docs, tmp_path):
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    out = pipeline.run(spark, folder)
    assert out.columns[0] == "doc_id" and 0 < out.count() < docs.count()
    here = docs.limit(0)
    for name, stage in pipeline.STAGES:
        here = stage(spark, here, folder)
        assert here.count() == 0, name


def test_stages_send_their_texts_in_small_batches(spark):
    """64 MB a batch, several of them at once, was a large part of an executor's memory."""
    docs = spark.createDataFrame([("x" * 1_000_000,) for _ in range(24)], "text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        pipeline.small_batches(spark)
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    assert sum(r["n"] for r in sizes) == 24 and max(r["n"] for r in sizes) <= 10
