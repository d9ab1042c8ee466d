"""Batches shown to plugged-in models, bounded regrouping, and verdicts of repeated ids."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from addrloom.models.pair_scorer import SimilarityScorer
from addrloom.models.plugged import PluggedEncoder, _cuts
from addrloom.operators import recall
from addrloom.plans import match


def show(spark, texts, load, **batches):
    df = spark.createDataFrame([(i, t, i % 7) for i, t in enumerate(texts)], "id long, address string, other int")
    return sorted(PluggedEncoder(load, **batches).transform(df.repartition(3)).collect(), key=lambda r: r["id"])


def test_batches_of_like_length(spark):
    rng = random.Random(5)
    texts = ["x" * int(rng.paretovariate(0.9) * 5 + 1) for _ in range(1200)] + ["", None]

    def load():
        # rows and padded characters of the batch a text was shown in
        return lambda shown: [[len(t or ""), len(shown), len(shown) * max(len(s or "") for s in shown)] for t in shown]

    rows = show(spark, texts, load, batch_rows=32, batch_chars=4000)
    assert [r["vector"][0] for r in rows] == [len(t or "") for t in texts]
    assert [(r["address"], r["other"], r["error"]) for r in rows] == [(t, i % 7, None) for i, t in enumerate(texts)]
    for r in rows:
        own, n, padded = r["vector"]
        assert n <= 32 and (padded <= 4000 or n == 1)
    # padded characters: each row bears its share of its batch's; in table order it is many times the text
    real = sum(len(t or "") for t in texts)
    ordered = sum(r["vector"][2] / r["vector"][1] for r in rows)
    as_given = sum(32 * max(len(t or "") for t in texts[a : a + 32]) for a in range(0, len(texts), 32))
    assert ordered <= 1.2 * real < 3 * real < as_given


def test_cuts_take_every_place_once():
    rng = random.Random(9)
    lengths = [rng.choice([0, 1, 5, 50, 500]) for _ in range(300)]
    batches = list(_cuts(lengths, 16, 600))
    assert sorted(p for b in batches for p in b) == list(range(300))
    assert all(len(b) <= 16 and (len(b) == 1 or len(b) * max(lengths[p] for p in b) <= 600) for b in batches)
    assert list(_cuts([], 4, 4)) == [] and list(_cuts([0, 9], 4, 4)) == [[0], [1]]
    with pytest.raises(ValueError):
        PluggedEncoder(lambda: None, batch_rows=0)


def test_one_load_a_worker_and_bad_rows_alone(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def run(shown):
            if any(t == "bad" for t in shown):
                raise ValueError("bad text")
            return [[float(len(t))] for t in shown]

        return run

    df = spark.createDataFrame([("bad" if i == 5 else "y" * (i % 9),) for i in range(400)], "address string").repartition(40)
    model = PluggedEncoder(load, batch_rows=8)
    for _ in range(2):
        rows = model.transform(df).collect()
        assert [(r["address"], r["vector"], r["error"]) for r in rows if r["error"]] == [("bad", None, "ValueError: bad text")]
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) < 40  # 80 tasks, one load a process


def test_empty_table(spark):
    df = spark.createDataFrame([], "address string")
    assert PluggedEncoder(lambda: lambda t: 1 / 0).transform(df).collect() == []


RECALL = "enterprise_id string, enterprise_name string, enterprise_address string, standard_id string, standard_address string, room_no string, similarity double"


def test_regroup_of_a_hot_query(spark):
    """Ten partitions send no more than top_n rows of the hot query each."""
    hot = spark.range(0, 30_000, 1, 10).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("e%d", F.col("id") % 900)).alias("enterprise_id"),
        F.lit("n").alias("enterprise_name"), F.lit("a").alias("enterprise_address"),
        F.format_string("%05d", "id").alias("standard_id"), F.lit("b").alias("standard_address"), F.lit("").alias("room_no"),
        (F.col("id") % 97 / 97.0).alias("similarity"),
    )
    top = recall.regroup(hot, 4)
    whole = {r["enterprise_id"]: r["candidates"] for r in recall.regroup(hot).collect()}
    assert {r["enterprise_id"]: r["candidates"] for r in top.collect()} == {e: c[:4] for e, c in whole.items()}
    plan = recall.regroup(hot, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and plan.count("Exchange hashpartitioning") == 1
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_regroup_top_without_candidates(spark):
    rows = [("e", "n", "a", None, None, None, 0.9), ("e", "n", "a", "", None, None, 0.9), ("f", "n", None, "2", "b", None, None),
            ("f", "n", None, "1", "b", None, 0.5), ("f", "n", None, None, "b", None, 0.9), ("f", "n", None, "3", "b", None, 0.5)]
    df = spark.createDataFrame(rows, RECALL)
    for top_n in (1, 2, 5):
        got = {r["enterprise_id"]: [c["source_id"] for c in r["candidates"]] for r in recall.regroup(df, top_n).collect()}
        assert got == {"e": [], "f": ["2", "1", "3"][:top_n]}


@pytest.mark.parametrize("threshold", [0.0, 0.4, 0.95])
def test_rows_of_one_id_keep_their_verdicts(spark, threshold):
    rows = [("e1", "n", "road A 1", "a", "road A 1", "", 0.9), ("e1", "n", "road B 2", "b", "road B 2", "", 0.8),
            ("e1", "m", "road A 1", "c", "road A 9", "", 0.5), ("e2", None, None, "d", "x", "", 0.6)]
    df = spark.createDataFrame(rows, RECALL)
    queries = df.select(*recall.ENTERPRISE).union(df.select(*recall.ENTERPRISE).where("enterprise_address = 'road B 2'"))
    want = {(r[0], r[1], r[2]): r[3] if r[6] >= threshold else None for r in rows}
    alone = match.rank_recall(df, SimilarityScorer(), "rounded", threshold).collect()
    assert len(alone) == 4
    given = match.rank_recall(df, SimilarityScorer(), "rounded", threshold, queries).collect()
    assert len(given) == 5  # the query given twice has two rows
    for r in alone + given:
        assert r["address_id"] == want[(r["enterprise_id"], r["enterprise_name"], r["enterprise_address"])]
