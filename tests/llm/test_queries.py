"""The registered queries: contract columns, and their SQL twins on the smallest tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from addrloom.llm.oracles import ORACLES
from addrloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op4_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op5_chat": {"conv_id": "bigint", "rendered": "string"},
    "op6_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9_sentencepiece": {"doc_id": "bigint", "n_tokens": "bigint", "round_trip": "boolean", "ids": "array<int>"},
    "op10_quality": {
        "doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
        "base_failed": "boolean", "kept": "boolean",
    },
    "op11_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op12_whitening": {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double",
    },
    "op13_centroids": {
        "vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string",
    },
}
TABLES = {"op4_html": "pages", "op5_chat": "conversations", "op12_whitening": "embeddings", "op13_centroids": "embeddings"}
ROWS_EACH = {"op12_whitening": 16}


def plain(value):
    return None if value is None or value != value else value


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        out.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return out


def test_every_operator_has_a_query():
    assert set(QUERIES) == set(COLUMNS) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.collect()
    if name != "op5_chat":
        assert len(rows) == ROWS_EACH.get(name, 1) * spark.read.parquet(f"{FOLDER}/{TABLES.get(name, 'documents')}.parquet").count()
    if name in ORACLES:
        want = con.execute(ORACLES[name])
        names = sorted(c[0] for c in want.description)
        assert names == sorted(df.columns)
        order = [next(i for i, c in enumerate(want.description) if c[0] == n) for n in names]
        found = Counter(tuple(plain(r[n]) for n in names) for r in rows)
        assert found == Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())
