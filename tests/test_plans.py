from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from addrloom import vocab
from addrloom.functions import prefixes, vectors
from addrloom.functions.scores import match_status
from addrloom.models.encoder import CharPairEncoder
from addrloom.models.pair_scorer import LogitPairScorer
from addrloom.models.plugged import PluggedEncoder, PluggedPairScorer, PluggedTagger
from addrloom.operators import knn
from addrloom.plans import evaluation, match, pairs, tagging, vectorize
from addrloom.sources import csv, logs, tables, tags
from addrloom.streaming import incremental


def test_encoder(spark):
    texts = ["广东省深圳市南山区科苑路8号", "深圳市南山区科苑路8号", "浙江省杭州市西湖区文三路268号", "", None, " 　"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, address string")
    got = {r["id"]: r["vector"] for r in CharPairEncoder().transform(df).collect()}
    assert got[3] is None and got[4] is None and got[5] is None
    v = np.array([got[i] for i in range(3)], dtype=float)
    assert v.shape == (3, vocab.VECTOR_DIM) and np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-6)
    assert v[0] @ v[1] > 0.75 > 0.4 > v[0] @ v[2]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "v array<float>, z array<float>")
    row = df.select(
        vectors.l2_norm(F.col("v")).alias("n"), vectors.l2_normalize(F.col("v")).alias("u"),
        vectors.l2_normalize(F.col("z")).alias("zu"), vectors.l2_distance(F.col("v"), F.col("z")).alias("d"),
        vectors.vector_text(F.col("v")).alias("t"), vectors.norm_is_off(F.col("v")).alias("off"),
        vectors.self_product_ok(F.col("v")).alias("ok"), vectors.cosine_from_l2(F.col("v"), F.col("v")).alias("c"),
    ).first()
    assert (row["n"], row["d"], row["t"], row["off"], row["ok"], row["c"]) == (5.0, 5.0, "[3.00000000,4.00000000]", True, False, 1.0)
    assert row["u"] == pytest.approx([0.6, 0.8]) and row["zu"] is None


def test_two_stage_finds_the_right_address(spark, gazetteer, tmp_path):
    made = evaluation.match_pairs(gazetteer, 200)
    other = evaluation.distractors(gazetteer, made, 600)
    queries = vectorize.encode(made.select(F.col("enterprise_id").alias("id"), F.col("enterprise_name").alias("name"), F.col("enterprise_address").alias("address")), "enterprise")
    standard = made.select(F.col("standard_addr_code").alias("id"), F.col("standard_address").alias("address"), F.col("house_code").alias("room_no"))
    standard = standard.unionByName(other.select(F.col("addr_code").alias("id"), F.col("standard_address").alias("address"), F.col("house_code").alias("room_no")))
    vectorize.vectorize(standard, str(tmp_path / "standard"), "standard")
    references = spark.read.parquet(str(tmp_path / "standard"))
    rows = match.two_stage(queries, references, top_n=10, threshold=0.3).collect()
    assert len(rows) == 200
    right = sum(r["enterprise_id"][-4:] == (r["address_id"] or "")[-4:] and r["address_id"].startswith("EVAL_A") for r in rows)
    assert right >= 190
    assert all(abs(r["exact_match"] + r["partial_match"] + r["not_match"] - 1) < 1e-9 for r in rows)
    # nothing within reach: absent, or kept with the no-candidate verdict
    assert match.two_stage(queries, references, top_n=3, threshold=1.01).count() == 0
    kept = match.two_stage(queries, references, top_n=3, threshold=1.01, keep_unmatched=True)
    assert kept.where(F.col("match_status") == vocab.NOT_MATCHED).count() == 200
    single = match.single_stage(made.select(F.col("enterprise_id").alias("id"), F.col("enterprise_name").alias("name"), F.col("enterprise_address").alias("address")), references, rank_threshold=0.3)
    assert single.count() == 200 and single.where("room_no = ''").count() < 20


def test_scorer_accuracy_on_unseen_pairs(spark, gazetteer):
    # districts, roads and buildings that the weights were not fitted on
    rows = [
        (0, "西湖区", ["文三路", "学院路", "天目山路"], ["翠苑街道", "北山街道"], ["翠苑社区"], ["求是大厦", "黄龙世纪广场"]),
        (1, "滨江区", ["网商路", "江南大道"], ["长河街道"], ["网商社区", "江虹社区"], ["海创基地", "星光大道中心"]),
        (2, "余杭区", ["文一西路", "荆长大道", "良睦路"], ["仓前街道", "五常街道"], ["永福社区"], ["梦想小镇", "未来科技城大厦"]),
    ]
    other_city = spark.createDataFrame(rows, gazetteer.schema)
    held_out = evaluation.labelled_pairs(other_city, 1500, province="浙江省", city="杭州市")
    judged = LogitPairScorer().transform(held_out).withColumn(
        "match_status", match_status(F.col("exact_match"), F.col("partial_match"), F.col("not_match"))
    )
    shares = {r["expected_match"]: r["right_rate"] for r in evaluation.accuracy(judged).collect()}
    assert shares["完全匹配"] > 85 and shares["部分匹配"] > 75 and shares["不匹配"] > 95
    fitted = evaluation.fit_on(gazetteer, 400)
    assert len(fitted.weights) == 3 and all(len(w) == 7 for w in fitted.weights)


def test_evaluation_set(spark, gazetteer):
    made = evaluation.match_pairs(gazetteer, 1000)
    assert made.count() == 1000
    assert made.select("standard_address").distinct().count() == 1000
    first = made.orderBy("group_id").first()
    assert (first["enterprise_id"], first["standard_addr_code"], first["house_code"]) == ("EVAL_E0001", "EVAL_A0001", "HC00000001")
    assert (first["consistency_type"], first["expected_match"]) == ("完全一致", "完全匹配")
    counts = {r["transform_type"]: r["count"] for r in made.groupBy("transform_type").count().collect()}
    assert counts == {i: 50 for i in range(20)}
    other = evaluation.distractors(gazetteer, made, 3000)
    assert other.join(made, "standard_address").count() == 0
    queries = made.select(F.col("enterprise_id").alias("source_id"), F.col("enterprise_address").alias("address"))
    references = made.select(F.col("standard_addr_code").alias("source_id"), F.col("standard_address").alias("address")).union(
        other.select("addr_code", "standard_address")
    )
    row = evaluation.verify(queries, references).first()
    assert (row["e_count"], row["a_count"], row["e_dup"], row["s_dup"]) == (1000, 1000, 0, 0)
    assert row["s_total"] == row["a_count"] + row["d_count"]


def test_pairs_blank_rows(spark):
    df = spark.createDataFrame([("1", "科苑路8号", "科苑路8号"), ("", " ", "x"), (None, None, "y"), ("4", "a　", "　")], "k string, a string, b string")
    rows = pairs.match_pairs(df, "a", "b", "k").collect()
    by = {r["address_a"]: r for r in rows}
    assert by["科苑路8号"]["match_status"] == vocab.EXACT and by["科苑路8号"]["identifier"] == "1"
    for a in (" ", "", "a　"):
        assert (by[a]["exact_match"], by[a]["partial_match"], by[a]["not_match"], by[a]["match_status"]) == (0.0, 0.0, 1.0, vocab.NOT_MATCHED)
    assert by[" "]["identifier"] is None and by[""]["identifier"] is None
    with pytest.raises(ValueError):
        pairs.match_pairs(df, "a", "nope")


def test_plugged_models_fail_row_by_row(spark):
    def load_scorer():
        def run(a, b):
            if "bad" in a:
                raise RuntimeError("bad row")
            return [(0.1, 0.2, 0.7)] * len(a)
        return run

    df = spark.createDataFrame([("1", "x", "y"), ("2", "bad", "y"), ("3", " ", "y")], "k string, a string, b string")
    rows = {r["identifier"]: (r["exact_match"], r["not_match"]) for r in pairs.match_pairs(df, "a", "b", "k", PluggedPairScorer(load_scorer)).collect()}
    assert rows == {"1": (0.7, 0.1), "2": (0.0, 1.0), "3": (0.0, 1.0)}

    def load_encoder():
        return lambda texts: [[float(len(t)), 1.0 / (len(t) - 3)] for t in texts]

    texts = spark.createDataFrame([("a",), ("abc",), ("abcde",)], "address string")
    got = {r["address"]: (r["vector"], r["error"]) for r in PluggedEncoder(load_encoder).transform(texts).collect()}
    assert got["abc"][0] is None and "ZeroDivisionError" in got["abc"][1]
    assert got["a"] == ([1.0, -0.5], None)
    ids = spark.createDataFrame([("1", "n", "a"), ("2", "n", "abc")], "id string, name string, address string")
    assert [r["source_id"] for r in vectorize.encode(ids, "enterprise", PluggedEncoder(load_encoder)).collect()] == ["1"]

    def load_tagger():
        def run(texts):
            if any(t == "bad" for t in texts):
                raise ValueError("no")
            return [(list(t), ["S-prov"] + ["O"] * (len(t) - 1)) for t in texts]
        return run

    rows = spark.createDataFrame([("xy",), ("bad",)], "a string")
    done = {r["original_address"]: (r["prov"], r["dom_json"]) for r in tagging.tag_addresses(rows, "a", "17", tagger=PluggedTagger(load_tagger)).collect()}
    assert done == {"xy": ("x", '[["prov", "x"]]'), "bad": ("", "[]")}


def test_prefixes(spark):
    cases = {
        "Batch 1!": "batch_1", "__": "default", "": "default", None: "default", "  ": "default", "福田": "futian",
        "福田-A区__2期": "futian_aqu_2z671f", "渝": "z6e1d", "！": "default", "été": "été",
    }
    df = spark.createDataFrame([(k,) for k in cases], "tag string")
    got = {r["tag"]: r["p"] for r in df.select("tag", prefixes.tag_prefix(F.col("tag")).alias("p")).collect()}
    assert got == cases
    readings = spark.createDataFrame([("福", "fu"), ("渝", "yu")], "char string, reading string")
    more = {r["tag"]: r["prefix"] for r in prefixes.with_tag_prefix(df, "tag", readings).collect()}
    assert more["渝"] == "yu" and more["福田"] == "fuz7530" and more["Batch 1!"] == "batch_1" and more[None] == "default"


def test_tags(spark):
    made = tags.create_tag(spark, " 福田 ")
    assert (made["tag_name"], made["prefix"], made["recall_table"], made["match_table"]) == ("福田", "futian", "futian_recall_results", "futian_match_results")
    assert tags.create_tag(spark, "福田")["created_at"] == made["created_at"]
    assert tags.create_tag(spark, "Other")["prefix"] == "other"
    assert [r["prefix"] for r in tags.all_tags(spark).collect()] == ["futian", "other"]
    assert tags.prefixes_in_catalog(spark) == ["futian", "other"]
    assert spark.table("futian_match_results").columns[0] == "enterprise_id"
    assert tags.delete_tag(spark, "futian") and not tags.delete_tag(spark, "futian")
    assert [r["prefix"] for r in tags.all_tags(spark).collect()] == ["other"]
    assert not spark.catalog.tableExists("futian_recall_results") and tags.find_tag(spark, "futian") is None


def test_csv_encodings(spark, tmp_path):
    header, rows = "id,地址", ["1,深圳市南山区", "2,广州市天河区"]
    samples = {"utf-8-sig": "a", "utf-8": "b", "gbk": "c", "gb18030": "d"}
    for codec, name in samples.items():
        extra = ["3,㐀𠀀"] if codec == "gb18030" else []  # beyond GBK
        (tmp_path / f"{name}.csv").write_bytes(("\n".join([header, *rows, *extra]) + "\n").encode(codec))
    (tmp_path / "e.csv").write_bytes(b"id,name\n1,caf\xe9\xff\x80\n")
    found = {r["file"][-5:]: r["encoding"] for r in csv.detect_encodings(spark, str(tmp_path / "*.csv")).collect()}
    assert found == {"a.csv": "utf-8-sig", "b.csv": "utf-8-sig", "c.csv": "gbk", "d.csv": "gb18030", "e.csv": "latin1"}
    df = csv.read_csv(spark, str(tmp_path / "[a-d].csv"), "id", "地址")
    assert df.columns == ["id", "地址"] and df.count() == 9
    assert {r["地址"] for r in df.collect()} == {"深圳市南山区", "广州市天河区", "㐀𠀀"}
    with pytest.raises(ValueError):
        csv.read_csv(spark, str(tmp_path / "b.csv"), "nope")


def test_csv_export(spark, tmp_path):
    df = spark.range(12).select("id", F.lit("深圳").alias("地址")).coalesce(1)
    csv.write_csv(df, str(tmp_path / "out"), rows_per_file=5, byte_order_mark=True)
    files = sorted((tmp_path / "out").glob("*.csv"))
    assert len(files) == 3
    assert all(f.read_bytes().startswith("﻿id,地址".encode()) for f in files)
    assert csv.read_csv(spark, str(tmp_path / "out" / "*.csv"), "id").count() == 12
    odd = spark.createDataFrame([('say "hi",\nthere', "深"), (" x\\", "圳")], "a string, b string")
    csv.write_csv(odd, str(tmp_path / "odd"))
    back = csv.read_csv(spark, str(tmp_path / "odd" / "*.csv"), multi_line=True)
    assert {tuple(r) for r in back.collect()} >= {('say "hi",\nthere', "深")}


def test_logs(spark, tmp_path):
    rows = [(i, lvl, f"m{i}") for i, lvl in enumerate(["INFO", "WARNING", "ERROR", "DEBUG", "CRITICAL", "WARNING"])]
    logs.append(spark.createDataFrame(rows, "id long, level string, message string"), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert [r["id"] for r in logs.latest(log).collect()] == [5, 4, 2, 1]
    assert [r["id"] for r in logs.latest(log, 1, "WARNING").collect()] == [5]


def test_sources(spark):
    df = spark.createDataFrame([(1, "n", "a", None), (2, None, "", "r"), (3, "m", None, "r")], "k int, nm string, ad string, room string")
    assert [tuple(r) for r in tables.query_addresses(df, "k", "nm", "ad").collect()] == [("1", "n", "a")]
    assert [tuple(r) for r in tables.query_addresses(df, "k", None, "ad").collect()] == [("1", "1", "a")]
    assert [tuple(r) for r in tables.reference_addresses(df, "k", "ad", "room").collect()] == [("1", "a", "")]
    assert tables.preview(df, 2).count() == 2
    plan = tables.address_pairs(df, "nm", "ad")
    assert plan.columns == ["identifier", "address_a", "address_b"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = lambda tag, n: spark.range(n).select("id", F.lit(tag).alias("tag"))
    tables.append(rows("a", 3), path, "tag")
    tables.append(rows("b", 2), path, "tag")
    tables.replace_partitions(rows("a", 1), path, "tag")
    counts = {r["tag"]: r["count"] for r in spark.read.parquet(path).groupBy("tag").count().collect()}
    assert counts == {"a": 1, "b": 2}
    tables.replace(rows("c", 4), path, "tag")
    assert spark.read.parquet(path).count() == 4


def test_streams(spark, tmp_path):
    inbox, target = tmp_path / "inbox", str(tmp_path / "vectors")
    schema = "id string, name string, address string"
    batch = lambda *ids: spark.createDataFrame([(i, "n", f"科苑路{i}号") for i in ids], schema).write.mode("append").parquet(str(inbox))
    run = lambda state: incremental.vectorize_stream(
        incremental.arriving(spark, str(inbox), schema), target, "enterprise", CharPairEncoder(64), str(tmp_path / state)
    ).awaitTermination()
    batch("1", "2")
    run("state")
    batch("2", "3")
    run("state")
    ids = lambda: sorted(r["source_id"] for r in spark.read.parquet(target).collect())
    assert ids() == ["1", "2", "3"]
    run("fresh state")  # everything is sent again: nothing is added
    assert ids() == ["1", "2", "3"]

    out = str(tmp_path / "tagged")
    query = incremental.tag_stream(
        incremental.arriving(spark, str(inbox), schema), "address", out, "17", "id", checkpoint=str(tmp_path / "tag state")
    )
    query.awaitTermination()
    assert incremental.progress(query, 4)["processed"] == 4 and incremental.progress(query, 4)["progress"] == 1.0
    assert spark.read.parquet(out).where("road = '科苑路'").count() == 4
    assert incremental.checkpoint_folder(spark, "x").endswith("/x")


def test_incremental_vectorize(spark, tmp_path):
    path = str(tmp_path / "v")
    make = lambda *ids: spark.createDataFrame([(i, "1", f"福华路{i}号") for i in ids], "id string, room_no string, address string")
    vectorize.vectorize(make("1", "1", "2"), path, "standard")
    assert spark.read.parquet(path).count() == 3  # an id given twice keeps both rows
    vectorize.vectorize_new(make("2", "3"), path, "standard")
    vectorize.vectorize_new(make("2", "3"), path, "standard")
    assert sorted(r["source_id"] for r in spark.read.parquet(path).collect()) == ["1", "1", "2", "3"]
    vectorize.vectorize(make("9"), path, "standard")
    assert spark.read.parquet(path).count() == 1


def test_listed_references_are_written_by_list(spark, tmp_path, gazetteer):
    made = evaluation.match_pairs(gazetteer, 100)
    vectors_ = vectorize.encode(made.select(F.col("standard_addr_code").alias("id"), F.col("house_code").alias("room_no"), F.col("standard_address").alias("address")), "standard", CharPairEncoder(64))
    centres = knn.fit_centres(vectors_, lists=5)
    tables.replace(knn.with_list_id(vectors_, centres), str(tmp_path / "listed"), "list_id")
    listed = spark.read.parquet(str(tmp_path / "listed"))
    assert listed.count() == 100
    queries = vectorize.encode(made.select(F.col("enterprise_id").alias("id"), F.col("enterprise_name").alias("name"), F.col("enterprise_address").alias("address")), "enterprise", CharPairEncoder(64))
    assert match.recall(queries, listed, 3, centres=centres, probes=5).count() == 300


def test_task_functions_need_no_installed_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from addrloom.models.encoder import _unit_vectors

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps([_unit_vectors, knn._best_of_chunk(3, None)]))
    code = "import pickle; f, g = pickle.load(open('f.pkl', 'rb')); print(f(['ab', 'b'], 16).shape)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.strip() == "(2, 16)", done.stderr


def test_stored_pipeline(spark, tmp_path, gazetteer):
    made = evaluation.match_pairs(gazetteer, 60)
    at = lambda name: str(tmp_path / name)
    side = lambda *c: made.select(*[F.col(a).alias(b) for a, b in c])
    vectorize.vectorize(side(("enterprise_id", "id"), ("enterprise_name", "name"), ("enterprise_address", "address")), at("q"), "enterprise")
    vectorize.vectorize(side(("standard_addr_code", "id"), ("house_code", "room_no"), ("standard_address", "address")), at("r"), "standard")
    found = match.run_recall(spark, at("q"), at("r"), "stored_recall", 5, 0.2).first()
    assert found["enterprise_count"] == 60 and found["recall_count"] == found["candidate_count"] <= 300
    row = match.run_ranking(spark, "stored_recall", at("m"), policy="raw", threshold=0.0).first()
    assert row["total_count"] == 60 and row["auto_match_count"] == 60
    row = match.run_two_stage(spark, at("q"), at("r"), at("recall"), "stored_match", 3, 1.01, keep_unmatched=True).first()
    assert (row["total_count"], row["not_match_rate"]) == (60, 100.0)
    assert spark.table("stored_match").columns[:3] == ["enterprise_id", "enterprise_name", "enterprise_address"]
    wrong = tables.vector_rows(spark.read.parquet(at("q")), "enterprise", 3)
    with pytest.raises(Exception, match="expected 3 numbers"):
        wrong.collect()
