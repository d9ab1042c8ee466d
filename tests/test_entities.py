from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from addrloom import vocab
from addrloom.functions import entities as en
from addrloom.functions import text as tx
from addrloom.models.tagger import LevelWordTagger
from addrloom.plans import tagging


def spans(tokens, labels):
    """A small row-by-row reading of the labelling rules."""
    out, open_kind, open_text = [], None, ""
    for token, label in zip(tokens, labels):
        mark, kind = label[:2], label[2:]
        if mark in ("I-", "E-") and kind == open_kind:
            open_text += token
        else:
            if open_kind:
                out.append((open_kind, open_text))
            open_kind, open_text = (kind, token) if mark in ("B-", "S-", "I-", "E-") else (None, "")
        if mark in ("S-", "E-") and open_kind:
            out.append((open_kind, open_text))
            open_kind, open_text = None, ""
    if open_kind:
        out.append((open_kind, open_text))
    return out


def built(spark, rows):
    df = spark.createDataFrame(rows, "id int, tokens array<string>, labels array<string>")
    done = en.spans_to_entities(en.clean_tokens(df)).select("id", "entities").collect()
    return {r["id"]: [tuple(e) for e in r["entities"]] for r in done}


def ruled(spark, address, entities, step=en.apply_rules):
    df = spark.createDataFrame([(address, entities)], f"address string, entities {en.ENTITIES}")
    return [tuple(e) for e in step(df).select("entities").first()[0]]


def test_spans_worked_case(spark):
    tokens = list("广东深圳9号x")
    labels = ["B-prov", "E-prov", "B-city", "I-city", "I-roadno", "E-roadno", "O"]
    assert built(spark, [(1, tokens, labels)])[1] == [("prov", "广东"), ("city", "深圳"), ("roadno", "9号")]


def test_spans_random(spark):
    rng = random.Random(5)
    marks = [m + k for m in ("B-", "I-", "E-", "S-") for k in ("prov", "city")] + ["O", "X-prov"]
    rows = []
    for i in range(300):
        n = rng.randrange(0, 12)
        rows.append((i, [rng.choice("abc市") for _ in range(n)], [rng.choice(marks) for _ in range(n)]))
    got = built(spark, rows)
    assert got == {i: spans(t, l) for i, t, l in rows}


def test_tokens_are_cleaned(spark):
    tokens, labels = ["[CLS]", "##广", "Ġ东", "[SEP]"], ["O", "B-prov", "E-prov", "S-city"]
    assert built(spark, [(1, tokens, labels)])[1] == [("prov", "广东")]


@pytest.mark.parametrize(
    ("entities", "expected"),
    [
        ([("houseno", "A栋")], [("subpoi", "A栋")]),
        ([("subpoi", "601室")], [("houseno", "601室")]),
        ([("subpoi", "海岸花园")], [("poi", "海岸花园")]),
        ([("subpoi", "s40")], [("houseno", "s40")]),
        ([("subpoi", "s4000")], [("subpoi", "s4000")]),
        ([("subpoi", "3号楼")], [("subpoi", "3号楼")]),
        ([("road", "12")], [("road", "12")]),
    ],
)
def test_retag(spark, entities, expected):
    step = lambda df: df.withColumn("entities", en.retag_by_suffix(F.col("entities")).cast(en.ENTITIES))
    assert ruled(spark, "", entities, step) == expected


def test_merge(spark):
    given = [("houseno", "6"), ("houseno", "01"), ("poi", "x"), ("poi", "y"), ("houseno", "7")]
    assert ruled(spark, "", given, en.merge_adjacent) == [("houseno", "601"), ("poi", "x"), ("poi", "y"), ("houseno", "7")]
    assert ruled(spark, "", [], en.merge_adjacent) == []


@pytest.mark.parametrize(
    ("address", "entities", "expected"),
    [
        ("科苑路8号1203", [("road", "科苑路"), ("roadno", "8号")], [("road", "科苑路"), ("roadno", "8号"), ("houseno", "1203")]),
        ("科苑路8号A 601室", [("road", "科苑路"), ("houseno", "8号")], [("road", "科苑路"), ("houseno", "8号A 601室")]),
        ("科苑路5铺", [("road", "科苑路")], [("road", "科苑路"), ("houseno", "5铺")]),
        ("科苑路旁边", [("road", "科苑路")], [("road", "科苑路")]),
        ("科苑路", [("road", "科苑路")], [("road", "科苑路")]),
    ],
)
def test_tail(spark, address, entities, expected):
    assert ruled(spark, address, entities, en.absorb_tail) == expected


@pytest.mark.parametrize(
    ("entities", "expected"),
    [
        ([("houseno", "601"), ("poi", "x")], [("houseno", "601"), ("floorno", "6"), ("poi", "x")]),
        ([("houseno", "1203室")], [("houseno", "1203室"), ("floorno", "12")]),
        ([("houseno", "60")], [("houseno", "60")]),
        ([("houseno", "a601"), ("houseno", "702")], [("houseno", "a601"), ("houseno", "702"), ("floorno", "7")]),
        ([("floorno", "3楼"), ("houseno", "601")], [("floorno", "3楼"), ("houseno", "601")]),
        ([("floorno", " 首 ")], [("floorno", "首层")]),
        ([], []),
    ],
)
def test_floor(spark, entities, expected):
    assert ruled(spark, "", entities, en.imply_floor) == expected


@pytest.mark.parametrize(
    ("address", "entities", "expected"),
    [
        ("福华路1408", [("road", "福华路"), ("houseno", "8")], [("road", "福华路"), ("houseno", "1408")]),
        ("福华路B室", [("road", "福华路"), ("houseno", "室")], [("road", "福华路"), ("houseno", "B室")]),
        ("福华路S40号", [("road", "福华路"), ("roadno", "号")], [("road", "福华路"), ("roadno", "S40号")]),
        ("福华路8号601", [("road", "福华路"), ("houseno", "8号")], [("road", "福华路"), ("houseno", "8号601")]),
        ("福华路 601室", [("road", "福华路")], [("road", "福华路"), ("houseno", "601室")]),
        ("福华路附近8", [("road", "福华路"), ("houseno", "8")], [("road", "福华路"), ("houseno", "8")]),
        # the first entity has nothing before it to take in
        ("12号", [("houseno", "号")], [("houseno", "号")]),
        # one that is not in the address stands where the one before ends
        ("福华路9", [("road", "福华路"), ("poi", "无"), ("houseno", "9")], [("road", "福华路"), ("poi", "无"), ("houseno", "9")]),
        ("福华路", [], []),
    ],
)
def test_boundaries(spark, address, entities, expected):
    assert ruled(spark, address, entities, en.expand_boundaries) == expected


def test_all_rules_in_order(spark):
    # nothing found in the address: each pass adds its share of the end
    assert ruled(spark, "a60 70室", [("subpoi", "a60"), ("houseno", "70室")]) == [("houseno", "a6070室70室a60")]


def test_fields(spark):
    given = [("poi", "A"), ("poi", "B"), ("devzone", 'q"C'), ("poi", "C"), ("assist", "z")]
    df = spark.createDataFrame([(given,)], f"entities {en.ENTITIES}")
    e = F.col("entities")
    twelve = df.select(*[c.alias(n) for n, c in en.fields_12(e).items()]).first().asDict()
    assert twelve == {f: "" for f in vocab.FIELDS_12} | {"area": 'ABq"CC'}
    seventeen = df.select(*[c.alias(n) for n, c in en.fields_17(e).items()]).first()
    assert (seventeen["poi"], seventeen["devzone"], seventeen["assist"], seventeen["prov"]) == ("ABC", 'q"C', "z", "")
    double = df.select(*[c.alias(n) for n, c in en.fields_34(e).items()]).first()
    assert (double["poi"], double["poi_2"], double["devzone_2"]) == ("A", "BC", "") and len(double) == 34
    text = df.select(en.dom_json(e)).first()[0]
    assert text == json.dumps([list(x) for x in given], ensure_ascii=False)


@pytest.mark.parametrize("mode", tagging.MODES)
def test_blank_addresses(spark, mode):
    df = spark.createDataFrame([("1", None), ("2", "   "), ("3", "　\t"), ("4", " 广东省深圳市 ")], "id string, addr string")
    rows = tagging.tag_addresses(df, "addr", mode, "id").collect()
    assert len(rows) == 4
    for r in rows:
        d = r.asDict()
        if d["original_address"].strip() == "":
            assert all(v == "" for k, v in d.items() if k not in ("original_address", "dom_json", "_id_field"))
            assert mode == "12" or d["dom_json"] == "[]"
        else:
            assert d["original_address"] == "广东省深圳市"


def test_native_tagger(spark):
    df = spark.createDataFrame([("广东省深圳市南山区粤海街道大冲社区科苑路8号A栋3单元12层1203室",)], "a string")
    r = tagging.tag_addresses(df, "a", "12", tagger=LevelWordTagger()).first()
    assert [r[f] for f in vocab.FIELDS_12] == [
        "广东省", "深圳市", "南山区", "粤海街道", "大冲社区", "科苑路", "8号", "", "A栋", "3单元", "12层", "1203室",
    ]


def test_unknown_mode_or_column(spark):
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(ValueError):
        tagging.tag_addresses(df, "a", "18")
    with pytest.raises(ValueError, match="nope"):
        tagging.tag_addresses(df, "nope", "17")


def test_json_texts_are_spelled_as_json_spells_them(spark):
    texts = ["", "plain", "路 3号", 'say "x"', "a\\b", "tab\tline\nnul\x00", "\x1f\x7f\x85", "𝒳/é'", "[x]", "]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    df = df.select("t", en._json_string(F.col("t")).alias("quick"), F.expr(r"regexp_replace(to_json(array(t)), '^\\[|\\]$', '')").alias("slow"))
    for r in df.collect():
        assert r["quick"] == r["slow"], r


def plain_spans(tokens, labels):
    out, opened = [], None
    for i, label in enumerate(labels):
        label = label or ""
        kind = label[2:] if label[:2] in ("B-", "I-", "E-", "S-") else ""
        if not kind:
            opened = None
            continue
        before = (labels[i - 1] or "") if i else ""
        if label[:2] in ("I-", "E-") and opened is not None and before[:2] in ("B-", "I-") and before[2:] == kind:
            opened[1] += tokens[i] or ""
        else:
            opened = [kind, tokens[i] or ""]
            out.append(opened)
    return [tuple(e) for e in out]


def test_spans_are_one_function_and_follow_the_labels(spark):
    rng = random.Random(3)
    labels = ["B-a", "I-a", "E-a", "S-b", "O", None, "", "B-", "I-b", "E-b", "X-a"]
    rows = []
    for i in range(600):  # more than are placed at one time
        n = rng.choice([0, 1, 2, 5, 9])
        rows.append((i, [rng.choice(["p", "qq", None, "", "路"]) for _ in range(n)], [rng.choice(labels) for _ in range(n)]))
    made = en.spans_to_entities(spark.createDataFrame([*rows, (600, ["p"], None), (601, None, ["B-a"])], "i int, tokens array<string>, labels array<string>"))
    # a chain of lambdas took microseconds for a token
    assert "lambda" not in made._jdf.queryExecution().executedPlan().toString().lower()
    got = {r["i"]: r["entities"] for r in made.collect()}
    for i, tokens, said in rows:
        assert [tuple(e) for e in got[i]] == plain_spans(tokens, said), (tokens, said)
    assert got[600] is None and [tuple(e) for e in got[601]] == [("a", None)]


def test_long_texts_are_stripped_and_cut_quickly(spark):
    text = " " + "word " * 800_000
    rows = spark.createDataFrame([(text,)], "address string").coalesce(1)
    seconds = []
    for _ in range(2):  # the first run also compiles
        began = time.time()
        found = LevelWordTagger().transform(rows).select(F.size("tokens").alias("n"), F.char_length(F.get("tokens", F.lit(0))).alias("c")).first()
        seconds.append(time.time() - began)
        assert (found["n"], found["c"]) == (1, len(text.strip()))
    assert min(seconds) < 3, seconds
    plain = "".join(c for c in map(chr, range(1, 0xD800)) if c.isspace())
    told = spark.createDataFrame([(plain + "a" + plain + "b" + plain,), (None,), (plain,)], "t string").select(tx.strip("t").alias("t")).collect()
    assert sorted([r["t"] for r in told], key=str) == sorted(["a" + plain + "b", None, ""], key=str)


def test_batches_of_the_rule_passes_are_bounded_in_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(64 << 20))
        df = spark.createDataFrame([(["a", "1"], ["B-poi", "S-houseno"], "a1")], "tokens array<string>, labels array<string>, address string")
        made = en.apply_rules(en.spans_to_entities(df))
        assert int(spark.conf.get(name)) <= 8 << 20
        assert [tuple(e) for e in made.first()["entities"]] == [("poi", "a"), ("houseno", "1")]
    finally:
        spark.conf.set(name, before)
