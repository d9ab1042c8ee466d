from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from addrloom import schemas, vocab
from addrloom.models.pair_scorer import LogitPairScorer
from addrloom.operators import checks, copies, corrections, filters, pages, pending, stats
from addrloom.plans import match

MATCH = (
    "enterprise_id string, enterprise_name string, enterprise_address string, address_id string, standard_address string, "
    "room_no string, partial_match double, exact_match double, not_match double, match_status string, correction_source string"
)


def matches(spark, count=4, source=vocab.SOURCE_AUTO):
    rows = [(f"E{i}", f"name{i}", f"addr{i}", f"S{i}", f"std{i}", "1", 0.1, i / 10, 0.2, vocab.PARTIAL, source) for i in range(count)]
    return spark.createDataFrame(rows, MATCH)


def test_recall_filter_conditions(spark):
    rows = [(f"e{i}", f"n{i}", f"a%{i}", f"s{i}", i / 10) for i in range(11)]
    df = spark.createDataFrame(rows, "enterprise_id string, enterprise_name string, enterprise_address string, standard_address string, similarity double")
    count = lambda f: df.where(filters.recall_filter(f)).count()
    assert count(None) == count({}) == count({"min_similarity": 0, "max_similarity": 1.0}) == count({"keyword": ""}) == 11
    assert count({"min_similarity": 0.8}) == 3
    assert count({"min_similarity": 0.2, "max_similarity": 0.5}) == 4
    assert count({"keyword": "n1"}) == 2
    assert count({"keyword": "s_"}) == 11  # wildcards stay wildcards


def test_match_filter_skips_open_bounds(spark):
    df = matches(spark, 10)
    count = lambda f: df.where(filters.match_filter(f)).count()
    assert count({"min_exact_match": 0, "max_exact_match": 1.0, "match_status": None, "correction_source": ""}) == 10
    assert count({"min_exact_match": 0.5}) == 5
    assert count({"max_exact_match": 0.0}) == 1
    assert count({"match_status": vocab.EXACT}) == 0
    assert count({"correction_source": "人工选择"}) == 0
    picked = matches(spark, 2, vocab.SOURCE_PICKED)
    assert picked.where(filters.match_filter({"correction_source": "人工选择"})).count() == 2


def test_pair_and_tag_filters(spark):
    pairs = spark.createDataFrame([("x路", "y", 0.9, 0.1, 0.0, vocab.EXACT)], "address_a string, address_b string, exact_match double, partial_match double, not_match double, match_status string")
    assert pairs.where(filters.pair_filter({"keyword": "路", "match_status": vocab.EXACT, "max_not_match": 0.5})).count() == 1
    tagged = spark.createDataFrame([("a", "", None, "d", "r", "p"), ("b", "P", "C", "", "", "")], "original_address string, province string, city string, district string, road string, area string")
    assert tagged.where(filters.tagged_filter({"has_province": True, "has_city": True})).count() == 1
    assert tagged.where(filters.tagged_filter({"has_district": True})).first()["original_address"] == "a"
    t17 = tagged.withColumnsRenamed({"province": "prov", "area": "poi"})
    assert t17.where(filters.tagged_filter({"has_province": True, "has_city": True}, "17_2")).first()["original_address"] == "b"


def test_ids(spark):
    df = matches(spark, 5)
    assert filters.by_ids(df, []).count() == 0
    assert filters.by_ids(df, ["E1", "E3", "zz"]).count() == 2
    assert filters.by_ids(df, spark.createDataFrame([("E1",), ("E1",)], "x string")).count() == 1


def test_pages(spark):
    df = spark.range(100).select(
        F.format_string("e%03d", F.col("id") % 7).alias("enterprise_id"), F.lit("n").alias("enterprise_name"),
        F.lit("a").alias("enterprise_address"), F.col("id").cast("string").alias("standard_id"),
        F.lit("b").alias("standard_address"), F.lit(0.5).alias("similarity"),
    )
    whole = [r["standard_id"] for r in pages.recall_page(df, None, 1, 100).collect()]
    cut = [r["standard_id"] for p in range(1, 6) for r in pages.recall_page(df, None, p, 20).collect()]
    assert cut == whole and len(set(whole)) == 100
    assert whole[40:60] == [r["standard_id"] for r in pages.recall_page(df, {}, 3, 20).collect()]
    assert pages.page_info(df, 5, 24).first().asDict() == {"total_count": 100, "page_count": 5, "first_row": 97, "last_row": 100}
    assert pages.page_info(df.limit(0)).first()["page_count"] == 1


@pytest.mark.parametrize(("total", "manual", "rate"), [(100, 15, 15.0), (200, 30, 15.0), (0, 0, 0.0)])
def test_match_statistics(spark, total, manual, rate):
    rows = [
        (f"E{i}", "n", "a", "s", "x", "", 0.2, 0.5, 0.3, vocab.EXACT,
         (vocab.SOURCE_PICKED if i % 3 else vocab.SOURCE_EDITED) if i < manual else (None if i % 2 else vocab.SOURCE_AUTO))
        for i in range(total)
    ]
    r = stats.match_stats(spark.createDataFrame(rows, MATCH)).first()
    assert (r["total_count"], r["manual_correction_count"], r["manual_correction_rate"]) == (total, manual, rate)
    assert r["auto_match_count"] == total - manual
    assert r["manual_select_count"] + r["manual_match_count"] == manual
    assert r["match_rate"] == (100.0 if total else 0.0) and r["avg_exact_match"] == (pytest.approx(0.5) if total else 0.0)


def test_fill_statistics(spark):
    df = spark.createDataFrame([("a", ""), ("b", None), (None, None), ("", "x")], "p string, q string")
    assert stats.fill_stats(df, ["p", "q"]).first().asDict() == {
        "total_count": 4, "p_count": 2, "q_count": 1, "p_rate": 50.0, "q_rate": 25.0,
    }
    assert stats.fill_stats(df.limit(0), ["p"]).first()["p_rate"] == 0.0


def test_picks_and_edits(spark):
    df = matches(spark, 4).union(matches(spark, 1))  # E0 twice: all its rows change
    picks = spark.createDataFrame(
        [("E0", "S8", "old", "r8", 1), ("E0", "S9", "new", None, 2), ("E2", "S7", "two", "r7", 1), ("E99", "x", "y", "z", 1)],
        "enterprise_id string, standard_id string, standard_address string, room_no string, seq int",
    )
    done = corrections.apply_picks(df, picks, "seq")
    assert done.columns == df.columns and done.count() == 5
    for r in done.where("enterprise_id = 'E0'").collect():
        assert (r["address_id"], r["standard_address"], r["room_no"]) == ("S9", "new", "")
        assert (r["exact_match"], r["partial_match"], r["not_match"]) == (1.0, 0.0, 0.0)
        assert (r["match_status"], r["correction_source"]) == (vocab.EXACT, vocab.SOURCE_PICKED)
    assert done.where("enterprise_id = 'E1'").first()["correction_source"] == vocab.SOURCE_AUTO
    assert corrections.correction_report(df, picks).first().asDict() == {"correction_count": 4, "updated_rows": 3}

    edits = spark.createDataFrame(
        [("E1", "S5", None, None, 1), ("E1", None, "second", None, 2), ("E3", None, None, None, 1)],
        "enterprise_id string, address_id string, standard_address string, room_no string, seq int",
    )
    done = {r["enterprise_id"]: r for r in corrections.apply_edits(matches(spark), edits, "seq").collect()}
    assert (done["E1"]["address_id"], done["E1"]["standard_address"], done["E1"]["room_no"]) == ("S5", "second", "1")
    assert (done["E3"]["address_id"], done["E3"]["correction_source"]) == ("S3", vocab.SOURCE_EDITED)
    assert done["E0"]["correction_source"] == vocab.SOURCE_AUTO


def test_copies_do_not_fan_out(spark):
    source = spark.createDataFrame([(1, "a"), (2, "a"), (3, " a "), (4, "zz"), (5, None)], "k int, addr string")
    blank = {f: "" for f in vocab.FIELDS_12}
    tagged = spark.createDataFrame([{**blank, "original_address": "a", "city": "C"}] * 3 + [{**blank, "original_address": "b"}])
    done = {r["k"]: r["city"] for r in copies.with_tags(source, "addr", tagged, "12").collect()}
    assert done == {1: "C", 2: "C", 3: "C", 4: None, 5: None}
    exact = {r["k"]: r["city"] for r in copies.with_tags(source, "addr", tagged, "12", exact_key=True).collect()}
    assert exact[3] is None
    unmatched = {r["k"]: r["city"] for r in copies.with_tags(source, "addr", tagged, "12", blank_unmatched=True).collect()}
    assert unmatched[4] == "" and unmatched[5] == ""


def test_pair_copy(spark):
    source = spark.createDataFrame([(1, "a", "b"), (2, "a", None), (3, "x", "y")], "k int, p string, q string")
    results = spark.createDataFrame(
        [("a", "b", 0.7, 0.2, 0.1, vocab.EXACT)] * 2 + [("a", "", 0.0, 0.0, 1.0, vocab.NOT_MATCHED)],
        "address_a string, address_b string, exact_match double, partial_match double, not_match double, match_status string",
    )
    done = {r["k"]: (r["exact_match"], r["not_match"], r["match_status"]) for r in copies.with_pair_scores(source, "p", "q", results).collect()}
    assert done == {1: (0.7, 0.1, vocab.EXACT), 2: (0.0, 0.0, vocab.NOT_MATCHED), 3: (0.0, 0.0, vocab.NOT_MATCHED)}


def test_pending(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, address string")
    stored = spark.createDataFrame([("2",), ("2",), ("x",)], "source_id string")
    assert {r["id"] for r in pending.unvectorized(rows, stored).collect()} == {1, 3}
    assert pending.unvectorized_count(rows, stored).first()[0] == 2
    assert pending.valid_count(spark.createDataFrame([("a",), ("",), (None,)], "x string"), "x").first()[0] == 1


def test_checks(spark):
    vectors = spark.createDataFrame(
        [("1", "a", [1.0, 0.0]), ("2", "a", [2.0, 0.0]), ("3", "b", None), ("4", "a", [0.0, 1.0])],
        "source_id string, address string, vector array<float>",
    )
    assert {r["source_id"] for r in checks.off_norm(vectors).collect()} == {"2", "3"}
    good = vectors.where("source_id in ('1', '4')")
    found = sorted((r["side"], r["source_id"], r["standard_id"], r["ok"]) for r in checks.same_address_similarity(good, good).collect())
    assert found == [(side, i, "1", i == "1") for side in ("query", "reference") for i in ("1", "4")]
    assert {r["source_id"] for r in checks.repeated(vectors, "address").collect()} == {"1", "2", "4"}
    dup = {r["column_name"]: r["duplicate_count"] for r in stats.duplicate_counts(vectors, "address", "source_id").collect()}
    assert dup == {"address": 2, "source_id": 0}


def test_alignment(spark):
    old = spark.createDataFrame([(7, 0.5)], "enterprise_id int, exact_match float").withColumn("extra", F.lit(1))
    new = schemas.align(old, schemas.MATCH, schemas.MATCH_DEFAULTS)
    assert [f.dataType for f in new.schema] == [f.dataType for f in schemas.MATCH] and new.columns == schemas.MATCH.names
    row = new.first()
    assert (row["enterprise_id"], row["exact_match"], row["correction_source"], row["address_id"]) == ("7", 0.5, vocab.SOURCE_AUTO, None)
    with pytest.raises(ValueError, match="nope"):
        schemas.require_columns(old, "enterprise_id", None, "nope")


def test_prefix_delete(spark):
    df = spark.createDataFrame([("EVAL_E1",), ("EVALX1",), ("other",), (None,)], "source_id string")
    assert {r[0] for r in filters.without_like(df, "source_id", "EVAL_%").collect()} == {"other", None}
    assert filters.count_like(df, "source_id", {"n": "EVAL_%"}).first()["n"] == 2


@pytest.mark.parametrize("threshold", [0.0, 0.6])
@pytest.mark.parametrize("keep_unmatched", [False, True])
def test_ranking_by_hashes_is_ranking_by_texts(spark, threshold, keep_unmatched):
    """Ids that repeat with other texts or the same, nulls, and queries out of reach."""
    v = lambda t: [float(np.cos(t)), float(np.sin(t))]
    queries = spark.createDataFrame(
        [("1", "n", "福田路1号", v(0.0)), ("1", None, "福田路2号", v(0.1)), ("2", "n", "福田路1号", v(1.5)), ("2", "n", "福田路1号", v(1.5)),
         (None, "n", "x", v(0.2)), ("4", "n", "far", v(3.0)), ("5", "n", "none", None)],
        "source_id string, enterprise_name string, address string, vector array<float>",
    )
    references = spark.createDataFrame(
        [("a", "福田路1号", "1", v(0.0)), ("a", "福田路1号", "1", v(0.0)), ("b", "福田路2号", None, v(0.1)), ("c", None, "3", v(1.5)), ("", "y", "4", v(1.4))],
        "source_id string, address string, room_no string, vector array<float>",
    )
    options = dict(policy="rounded", threshold=threshold, queries=match.enterprises(queries) if keep_unmatched else None)
    by_texts = match.rank_recall(match.recall(queries, references, 3, 0.0), LogitPairScorer(), **options)
    by_hashes = match.two_stage(queries, references, 3, 0.0, LogitPairScorer(), "rounded", threshold, keep_unmatched)
    assert by_hashes.columns == by_texts.columns
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(by_hashes) == rows(by_texts)
