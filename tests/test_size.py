"""Results do not depend on how large a table is, how it is stored, or how often an id occurs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from addrloom.functions import prefixes
from addrloom.models.encoder import CharPairEncoder
from addrloom.models.plugged import PluggedEncoder, PluggedPairScorer, PluggedTagger
from addrloom.operators import filters, knn, pages, rank, recall
from addrloom.plans import evaluation, match, pairs, tagging, vectorize
from addrloom.sources import tables
from addrloom.streaming import incremental

QUERY = "source_id string, enterprise_name string, address string, vector array<float>"
REFERENCE = "source_id string, address string, room_no string, vector array<float>"


def unit(rng, n, d):
    v = rng.normal(size=(n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def sides(spark, q, r, name=lambda i: f"q{i}"):
    a = spark.createDataFrame([(name(i), "n", f"a{i}", [float(x) for x in v]) for i, v in enumerate(q)], QUERY)
    b = spark.createDataFrame([(f"r{i}", f"b{i}", "", [float(x) for x in v]) for i, v in enumerate(r)], REFERENCE)
    return a, b


def test_rows_of_one_id_are_queries_of_their_own(spark):
    rng = np.random.default_rng(0)
    q, r = unit(rng, 12, 6), unit(rng, 90, 6)
    a, b = sides(spark, q, r, lambda i: f"q{i % 3}")
    for options in ({}, {"cell_rows": 10, "chunk_rows": 8}):
        rows = knn.knn_join(a, b, 4, **options).collect()
        assert len(rows) == 48 and "query_row" not in rows[0].__fields__
        for i, v in enumerate(q):
            best = {f"r{j}" for j in np.argsort(((r - v) ** 2).sum(axis=1))[:4]}
            assert {x["standard_id"] for x in rows if x["enterprise_address"] == f"a{i}"} == best
    nested = recall.regroup(knn.knn_join(a, b, 4))
    assert [x["n"] for x in nested.select(F.size("candidates").alias("n")).collect()] == [4] * 12


def test_all_rows_of_an_id_are_encoded(spark):
    df = spark.createDataFrame([("1", "n", "路1号"), ("1", "n", "路2号"), ("1", "n", "路2号")], "id string, name string, address string")
    assert sorted(r["address"] for r in vectorize.encode(df, "enterprise", CharPairEncoder(32)).collect()) == ["路1号", "路2号", "路2号"]


def test_stored_index(spark, tmp_path):
    rng = np.random.default_rng(2)
    q, r = unit(rng, 20, 8), unit(rng, 400, 8)
    a, b = sides(spark, q, r)
    at = {n: str(tmp_path / n) for n in ("q", "r", "recall", "match")}
    tables.replace(tables.vector_rows(a, "enterprise"), at["q"])
    vectorize.index(tables.vector_rows(b, "standard"), at["r"], lists=9)
    stored = spark.read.parquet(at["r"])
    assert "list_id" in stored.columns and stored.count() == 400 and (tmp_path / "r").glob("list_id=*")
    centres = knn.load_centres(spark, vectorize.centres_path(at["r"]))
    assert centres.shape == (9, 8)
    match.run_recall(spark, at["q"], at["r"], at["recall"], 5, probes=9)
    every = {(x["enterprise_id"], x["standard_id"]) for x in spark.read.parquet(at["recall"]).collect()}
    assert every == {(x["enterprise_id"], x["standard_id"]) for x in knn.knn_join(a, b, 5).collect()}
    summary = match.run_two_stage(spark, at["q"], at["r"], at["recall"], at["match"], 5, scorer=rankless(), probes=2)
    assert summary.first()["total_count"] == 20
    few = spark.read.parquet(at["recall"]).count()
    assert 0 < few <= 100


def rankless():
    from addrloom.models.pair_scorer import SimilarityScorer

    return SimilarityScorer()


def test_incremental_rows_join_the_lists(spark, tmp_path):
    path = str(tmp_path / "v")
    make = lambda *ids: spark.createDataFrame([(str(i), "", f"福华路{i}号") for i in ids], "id string, room_no string, address string")
    vectorize.vectorize(make(*range(60)), path, "standard", CharPairEncoder(32), lists=4)
    vectorize.vectorize_new(make(*range(50, 80)), path, "standard", CharPairEncoder(32))
    rows = spark.read.parquet(path)
    assert rows.count() == 80 and rows.where("list_id is null").count() == 0


def test_centres_see_every_row(spark):
    """Two far groups, one of a single row: its centre is found only if no row is left out."""
    rows = [("r%d" % i, "a", "", [1.0, i / 1e6]) for i in range(2000)] + [("far", "a", "", [-1.0, 0.0])]
    b = spark.createDataFrame(rows, REFERENCE)
    assert knn.most_cells(64) == 4000 and knn.most_cells(1536) == 2666 and knn.most_cells(10**9) == 1
    centres = knn.fit_centres(b, 2)
    assert abs(centres[:, 0].mean()) < 1.1 and len(centres) == 2
    with pytest.raises(ValueError):
        knn.fit_centres(b, 5000)


def test_cells_shrink_with_the_dimension(spark, monkeypatch):
    monkeypatch.setattr(knn, "MAX_CENTRE_NUMBERS", 40)
    rng = np.random.default_rng(4)
    a, b = sides(spark, unit(rng, 5, 8), unit(rng, 200, 8))
    found = {(x["enterprise_id"], x["standard_id"]) for x in knn.knn_join(a, b, 3, cell_rows=10).collect()}
    monkeypatch.undo()
    assert found == {(x["enterprise_id"], x["standard_id"]) for x in knn.knn_join(a, b, 3).collect()}


def test_model_sees_only_candidates_that_pass(spark):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def run(a, b):
            seen.add(len(a))
            return [(0.1, 0.2, 0.7)] * len(a)

        return run

    rows = [(f"e{i % 5}", "n", "a", f"s{i}", "b", "", 0.01 * i) for i in range(100)] + [("e9", "n", "a", None, None, "", 0.99), ("e8", "n", "a", "s", "b", "", 0.1)]
    df = spark.createDataFrame(rows, "enterprise_id string, enterprise_name string, enterprise_address string, standard_id string, standard_address string, room_no string, similarity double")
    best = match.rank_recall(df, PluggedPairScorer(load), threshold=0.8).collect()
    assert seen.value == 20
    assert {r["enterprise_id"]: r["address_id"] is not None for r in best} == {**{f"e{i}": True for i in range(5)}, "e8": False, "e9": False}


def test_reasons_of_failures(spark):
    def scorer():
        def run(a, b):
            if "bad" in a:
                raise RuntimeError("no score")
            return [(0.1, 0.2, 0.7)] * len(a)
        return run

    def tagger():
        def run(texts):
            if "bad" in texts:
                raise ValueError("no tags")
            return [([t], ["S-road"]) for t in texts]
        return run

    def encoder():
        return lambda texts: [[1.0 / (t != "bad")] for t in texts]

    df = spark.createDataFrame([("1", "n", "good", "x"), ("2", "n", "bad", "x")], "id string, name string, address string, other string")
    by = lambda rows, k: {r[k]: r["error"] for r in rows}
    assert by(pairs.match_pairs(df, "address", "other", "id", PluggedPairScorer(scorer)).collect(), "identifier") == {"1": None, "2": "RuntimeError: no score"}
    assert by(tagging.tag_addresses(df, "address", "17", "id", PluggedTagger(tagger)).collect(), "_id_field") == {"1": None, "2": "ValueError: no tags"}
    assert [r["source_id"] for r in vectorize.failed(df, PluggedEncoder(encoder)).collect()] == ["2"]
    recalled = df.selectExpr("id enterprise_id", "name enterprise_name", "address enterprise_address", "id standard_id", "other standard_address", "'' room_no", "0.9D similarity")
    assert by(rank.pick_best(rank.score(recalled, PluggedPairScorer(scorer)), threshold=0).collect(), "enterprise_id")["2"] == "RuntimeError: no score"


def test_streams_read_files_and_folders(spark, tmp_path):
    schema = "id string, name string, address string"
    rows = spark.createDataFrame([(str(i), "n", f"科苑路{i}号") for i in range(9)], schema)
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "t.parquet"))
    part = next(iter((tmp_path / "folder" / "t.parquet").glob("part-*")))
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "t.parquet").write_bytes(part.read_bytes())
    for kind, count in (("folder", 9), ("file", spark.read.parquet(str(part)).count())):
        target = str(tmp_path / f"out-{kind}")
        found = incremental.arriving(spark, f"{tmp_path}/{kind}/t.parquet*", schema)
        incremental.vectorize_stream(found, target, "enterprise", CharPairEncoder(16), str(tmp_path / f"state-{kind}")).awaitTermination()
        assert spark.read.parquet(target).count() == count


def test_backslash_in_a_keyword(spark):
    df = spark.createDataFrame([("a%b",), ("axb",), ("a\\b",), ("ab",)], "t string")
    hits = lambda word: {r["t"] for r in df.where(filters.keyword(["t"], word)).collect()}
    assert hits("a%b") == {"a%b", "axb", "a\\b", "ab"} and hits("a\\%b") == {"a%b"} and hits("a\\xb") == {"axb"}
    assert hits("a\\\\b") == {"a\\b"} and hits("a_b") == {"a%b", "axb", "a\\b"}


def test_full_number_of_distractors(spark, gazetteer):
    pairs_ = evaluation.match_pairs(gazetteer, 60)
    first = evaluation.distractors(gazetteer, pairs_, 40).collect()
    used = spark.createDataFrame([(r["standard_address"], "x") for r in first[::3]], "enterprise_address string, standard_address string")
    again = [r["standard_address"] for r in evaluation.distractors(gazetteer, used, 40).collect()]
    assert len(first) == len(again) == 40 and not {r["standard_address"] for r in first[::3]} & set(again)


FORMS = [
    ("广东省深圳市D路9号", "广东省深圳市D路9号", "地址文本完全相同"), ("广东深圳市D路9号", "广东省深圳市D路9号", "企业地址省略'省'字"),
    ("深圳市D路9号", "广东省深圳市D路9号", "企业地址省略省份"), ("广东深圳D路9号", "广东省深圳市D路9号", "企业地址省略'省'和'市'字"),
    ("D路9号", "广东省深圳市D路9号", "企业地址省略省份和'市'"), ("深圳市D路9号", "广东省深圳市DS路9号", "标准地址补充了'S'"),
    ("深圳市D路9号", "广东省深圳市DSM路9号", "标准地址补充了'SM'"),
    ("广东省深圳市D路9号A栋6楼601室", "广东省深圳市D路9号A幢6层601房", "'栋'与'幢'、'楼'与'层'、'室'与'房'同义替换"),
    ("广东省深圳市D路9号B座12层1203", "广东省深圳市D路9号B栋12楼1203室", "'座'与'栋'、'层'与'楼'同义，企业地址省略'室'"),
    ("广东省深圳市D路9号3号楼15层", "广东省深圳市D路9号3幢15楼", "'号楼'与'幢'、'层'与'楼'同义替换"),
    ("广东省深圳市D路9号8F", "广东省深圳市D路9号8楼", "'8F'与'8楼'为同一楼层的不同表达"),
    ("广东省深圳市D路9号22/F", "广东省深圳市D路9号22层", "'22/F'与'22层'为同一楼层的不同表达"),
    ("广东省深圳市D路9号B1", "广东省深圳市D路9号负1层", "'B1'与'负1层'为同一地下楼层的不同表达"),
    ("广东省深圳市D路9号A-601", "广东省深圳市D路9号A栋601室", "'A-601'与'A栋601室'为同一房间的不同表达"),
    ("广东省深圳市D路9号1203房", "广东省深圳市D路9号1203室", "'房'与'室'同义替换"),
    ("广东省深圳市D路9号3-1502", "广东省深圳市D路9号3栋1502室", "'3-1502'与'3栋1502室'为同一房间的不同表达"),
    ("广东省深圳市D路9-1号", "广东省深圳市D路9号附1号", "'9-1号'与'9号附1号'为同一地址的不同格式"),
    ("深圳市D路9号（大楼中心厦）", "广东省深圳市D路9号大楼中心厦", "企业地址用括号标注'大楼中心厦'，标准地址无括号"),
    ("深圳市D路9号大楼", "广东省深圳市D路9号大楼中心厦", "'大楼'与'大楼中心厦'为同一建筑的不同简称"),
    ("深圳市DM路9号", "广东省深圳市D路9号", "企业地址多了社区名'M'，标准地址省略"),
]
OTHERS = ["广东省深圳市DS路9号", "广东省深圳市D路9号大楼中心厦", "广东省深圳市D路9号3栋3楼3" + "01室", "广东省深圳市D路9号A座4层", "广东省深圳市D路9号附2号", "广东省深圳市D路9号之一"]


def test_the_forms_literally(spark):
    row = ("'D' district", "'路' road", "9L number", "array('S') streets", "array('M') communities", "array('大楼中心厦') buildings")
    made = evaluation.write_variants(spark.range(20).selectExpr("id", *row), F.col("id")).orderBy("id").collect()
    assert [(r["enterprise_address"], r["standard_address"], r["semantic_diff"]) for r in made] == FORMS
    others = evaluation.write_distractors(spark.range(6).selectExpr("id", *row), F.col("id")).orderBy("id").collect()
    assert [r["standard_address"] for r in others] == OTHERS


def test_pages_after_a_key(spark):
    df = spark.range(95).selectExpr("id % 7 as a", "id as b")
    whole = [tuple(r) for r in df.orderBy("a", "b").collect()]
    got, last = [], None
    while rows := pages.page_after(df, ["a", "b"], last, 20).collect():
        got += [tuple(r) for r in rows]
        last = (rows[-1]["a"], rows[-1]["b"])
    assert got == whole


def test_tags_from_a_reading_table(spark):
    readings = spark.createDataFrame([("上", "shang"), ("海", "hai")], "char string, reading string")
    assert prefixes.read_tag("上海-1", readings) == "shanghai_1" and prefixes.read_tag("b 1", readings) == "b_1"
