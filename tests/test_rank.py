from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from addrloom import vocab
from addrloom.functions import scores
from addrloom.models.pair_scorer import SimilarityScorer
from addrloom.operators import rank, recall

SCORED = (
    "enterprise_id string, enterprise_name string, enterprise_address string, standard_id string, "
    "standard_address string, room_no string, similarity double, exact_match double, partial_match double, not_match double"
)


def scored(spark, *rows):
    return spark.createDataFrame([("e", "n", "a", i, "addr " + (i or ""), room, s, x, p, n) for i, room, s, x, p, n in rows], SCORED)


def test_threshold_keeps_one_two_three(spark):
    df = spark.createDataFrame([(0.9,), (0.5,), (0.3,)], "similarity double")
    assert [df.where(rank.passes(t)).count() for t in (0.8, 0.4, 0)] == [1, 2, 3]
    missing = spark.createDataFrame([(None,)], "similarity double")
    assert missing.where(rank.passes(0.8)).count() == 1


def test_policies_differ(spark):
    # exact scores that are equal to two digits, but not raw
    df = scored(spark, ("1", "r1", 0.9, 0.501, 0.2, 0.299), ("2", None, 0.95, 0.504, 0.1, 0.396))
    assert rank.pick_best(df, "rounded", 0).first()["address_id"] == "1"
    best = rank.pick_best(df, "raw", 0).first()
    assert (best["address_id"], best["room_no"], best["correction_source"]) == ("2", "", vocab.SOURCE_AUTO)
    with pytest.raises(ValueError):
        rank.pick_best(df, "other", 0)


def test_ties_go_to_the_more_similar_then_smaller_id(spark):
    same = (0.5, 0.3, 0.2)
    df = scored(spark, ("3", "", 0.8, *same), ("2", "", 0.9, *same), ("1", "", 0.9, *same))
    for policy in rank.POLICIES:
        assert rank.pick_best(df, policy, 0).first()["address_id"] == "1"


def test_no_candidate_verdict(spark):
    df = scored(spark, ("1", "r", 0.5, 0.9, 0.1, 0.0), (None, None, None, 1.0, 0.0, 0.0))
    everyone = spark.createDataFrame([("e", "n", "a"), ("f", "m", "b")], "enterprise_id string, enterprise_name string, enterprise_address string")
    rows = {r["enterprise_id"]: r for r in rank.pick_best(df, threshold=None, queries=everyone).collect()}
    assert set(rows) == {"e", "f"}
    for r in rows.values():  # 0.5 is below the default threshold
        assert (r["address_id"], r["standard_address"], r["room_no"]) == (None, None, "")
        assert (r["exact_match"], r["partial_match"], r["not_match"], r["match_status"]) == (0.0, 0.0, 1.0, vocab.NOT_MATCHED)
    assert rank.pick_best(df, threshold=0.4).first()["address_id"] == "1"


def test_hot_query_is_one_row(spark):
    hot = spark.range(20_000).select(
        F.lit("e").alias("enterprise_id"), F.lit("n").alias("enterprise_name"), F.lit("a").alias("enterprise_address"),
        F.format_string("%05d", "id").alias("standard_id"), F.lit("b").alias("standard_address"), F.lit("").alias("room_no"),
        (F.col("id") % 97 / 97.0).alias("similarity"),
    )
    row = rank.pick_best(rank.score(hot, SimilarityScorer()), threshold=0).collect()
    assert [r["address_id"] for r in row] == ["00096"]
    nested = recall.regroup(hot)
    assert [r["n"] for r in nested.select(F.size("candidates").alias("n")).collect()] == [20_000]
    assert recall.flatten(nested).exceptAll(hot.select(*recall.flatten(nested).columns)).count() == 0


def test_regroup_order_and_missing(spark):
    df = scored(spark, ("2", "b", 0.5, 0.0, 0.0, 0.0), ("1", None, 0.9, 0.0, 0.0, 0.0), (None, "", 0.99, 0.0, 0.0, 0.0), ("", "", 0.99, 0.0, 0.0, 0.0))
    row = recall.regroup(df).first()
    assert [c["source_id"] for c in row["candidates"]] == ["1", "2"]
    assert {r["standard_id"]: r["room_no"] for r in recall.flatten(recall.regroup(df)).collect()} == {"1": "", "2": "b"}
    assert recall.summary(df).first().asDict() == {"enterprise_count": 1, "recall_count": 4, "candidate_count": 3}


@pytest.mark.parametrize(
    ("e", "p", "n", "word"),
    [
        (0.5, 0.5, 0.0, vocab.EXACT), (0.3, 0.3, 0.3, vocab.EXACT), (0.1, 0.45, 0.45, vocab.PARTIAL),
        (0.1, 0.2, 0.7, vocab.NOT_MATCHED), (0.0, 0.0, 1.0, vocab.NOT_MATCHED),
    ],
)
def test_status(spark, e, p, n, word):
    df = spark.createDataFrame([(e, p, n)], "e double, p double, n double")
    assert df.select(scores.match_status(F.col("e"), F.col("p"), F.col("n"))).first()[0] == word


def test_score_functions(spark):
    df = spark.createDataFrame([(0.125, 3, 0, 1.0, 2.0, 900.0)], "x double, a int, b int, z0 double, z1 double, z2 double")
    soft = scores.softmax3(F.col("z0"), F.col("z1"), F.col("z2"))
    row = df.select(
        scores.round2(F.col("x")).alias("r"), scores.percent(F.col("a"), F.col("b")).alias("none"),
        scores.class_name(F.lit(2)).alias("c2"), scores.class_name(F.lit(3)).alias("c3"),
        *[c.alias(n) for n, c in soft.items()],
    ).first()
    assert (row["r"], row["none"], row["c2"], row["c3"]) == (0.12, 0.0, "exact_match", None)
    assert row["exact_match"] == 1.0 and row["not_match"] + row["partial_match"] + row["exact_match"] == pytest.approx(1)
