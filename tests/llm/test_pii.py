"""Personal data against a plain reading of its definition."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from addrloom.llm import pii
from addrloom.llm.keys import marked
from addrloom.llm.oracles import ORACLES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", " ", "no data here", "mail a.b@c.de and x@y", "a@b.com_foo@x.yz", "a@b.com.x@y.z1", "é ü 𝒳 me@ex.org 1.2.3.4",
    "1.2.3.4.5.6.7.8 999.1.1.1 255.255.255.255 001.02.3.4 256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111, 4111111111111112",
    "4111111111111111 4111111111111111", "+1 (988) 555-2485 or +123", "+1 (988) 555-2485+49 30 1234567.", "5 5 5 +", "++1 2345678",
    "x" * 50000, "1" * 50000, "1.1." * 5000, "a@" * 3000, "a.b" * 5000 + "@c.d", "- 1 2-3 4-5 6-7 8-9 0-1 2-3 4-5 6",
    "@a.b x%y+z-1@a-b.c-d.e- 1.2.3", "\n\nq@w.er\n\n+44 20 7946 0958\n", "٣.٣.٣.٣ ４１１１", "[$x] \\1 a|b@c.d|e",
]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.find(df, **options).select("document.doc_id", pii.joined(*pii.KINDS).alias("base"), pii.joined(*pii.KINDS, pii.TERM).alias("spans"))
    return out.collect()


def test_base_spans(spark):
    rows = list(enumerate(TEXTS))
    got = {r["doc_id"]: r["base"] for r in found(spark, rows)}
    for i, text in rows:
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text))
        assert got[i] == want, text[:80]


def words(text):
    return re.findall(r"[^\W_]{3,}", text.lower())


def plain_told(rows, min_texts=pii.MIN_TEXTS, discloses=pii.DISCLOSES):
    """Disclosing terms by counting everything in plain Python."""
    texts = sorted({t or "" for _, t in rows})
    held, outside = defaultdict(set), {}
    for text in texts:
        inside = [False] * len(text)
        for kind, a, b in plain_spans(text):
            value = text[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])
            held[f"{kind}:{value}"].add(text)
            inside[a:b] = [True] * (b - a)
        outside[text] = set(words("".join(" " if x else c for c, x in zip(text, inside)))) & set(words(text))
    spoken = {t: set(words(t)) for t in texts}

    @functools.cache
    def marks(text):
        w = words(text)
        pairs = {f"{a} {b}" for a, b in zip(w, w[1:])} or set(w[:1])
        return [min(hashlib.md5(f"{k}:{x}".encode()).hexdigest() for x in pairs) for k in range(8)]

    told = {}
    for having in held.values():
        if len(having) < min_texts or len(rows) <= len(having):
            continue
        for term in set().union(*(outside[t] for t in having)):
            both = [t for t in having if term in outside[t]]
            support = min(len({m[k] for m in map(marks, both)}) for k in range(8))
            if len(both) < min_texts or support < min_texts:
                continue
            q = len(both) / sum(term in s for s in spoken.values())
            m, z = support / q, 1.645
            p = (q + z * z / (2 * m) - z * math.sqrt(max(q * (1 - q) / m + z * z / (4 * m * m), 0))) / (1 + z * z / m)
            share = 1 + math.log(p) / math.log(len(rows) / len(having))
            if p >= 0.5 and share >= discloses:
                told[term] = max(share, told.get(term, 0))
    return told


def plain_term_spans(text, told):
    return [("term", m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text or "") if m[0].lower() in told]


def corpus(near=0):
    """Five people whose names go with their numbers in texts of their own, two of them not always; and clean texts."""
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(400)]
    filler = lambda n=30: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = []
    for who, (name, value, n) in enumerate([
        ("Zephyrine", "zed@corp.com", 8), ("Vexley", "+41 44 668 18 00", 6), ("Quixo", "10.20.30.40", 3), ("Common", "4111 1111 1111 1111", 6), ("Rarely", "r@x.yz", 2)
    ]):
        for _ in range(n):
            rows.append(f"{filler()}\n{name} {filler(3)}\n{filler()} {value} {filler()}")
        rows += [f"{filler()} {name.upper()} alone {filler()}"] * (1 if who < 2 else 0)
    rows += [f"{filler()} common {filler()}" for _ in range(12)]
    # near copies of one text with a value, and exact copies: they prove nothing
    one = f"{filler(150)} solo@corp.com Hapax {filler(150)}".split(" ")
    for _ in range(6):
        one = list(one)
        one[rng.randrange(100)] = rng.choice(vocabulary)
        rows.append(" ".join(one))
    rows += [rows[-1]] * 4 + [None, "", " "] + [filler(60) for _ in range(400)]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def planted(spark):
    rows = corpus()
    return rows, {r["doc_id"]: r["spans"] for r in found(spark, rows)}


def test_disclosing_terms(planted):
    rows, got = planted
    told = plain_told(rows)
    assert {"zephyrine", "vexley", "quixo"} <= set(told) and not {"common", "rarely", "hapax"} & set(told)
    for doc, text in rows:
        spans = plain_spans(text or "") + plain_term_spans(text, told)
        assert got[doc] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans), text


def test_clean_documents_keep_their_text(spark, planted):
    """Precision where terms are found: no text without data or a person's name changes."""
    rows, _ = planted
    names = ("zephyrine", "vexley", "quixo")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    for doc, text in rows:
        if text is None or not plain_spans(text) and not any(w in text.lower() for w in names):
            assert clean[doc] == text
        else:
            assert not any(w in clean[doc].lower() for w in names) and not plain_spans(clean[doc])


def test_twin_where_terms_are_found(planted):
    """The SQL twin over the planted rows."""
    rows, got = planted
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.execute(ORACLES["op3_pii"])
    at = {c[0]: i for i, c in enumerate(want.description)}
    out = {r[at["doc_id"]]: r[at["spans"]] for r in want.fetchall()}
    assert out == got and sum("term" in s for s in out.values()) >= 14


@pytest.mark.parametrize("threshold", [str(10 << 20), "-1"])
def test_terms_are_counted_below_the_join(spark, threshold):
    """One row per term and partition is shipped, whatever the planner thinks of the wanted terms' size."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = spark.createDataFrame(corpus(), "doc_id long, text string").where("text is not null")
        wanted = spark.createDataFrame([("vexley",), ("word1",)], "term string")
        counted = pii.counted_terms(rows, F.col("text"), wanted, "n")
        plan = counted._jdf.queryExecution().optimizedPlan().toString().split("\n")
        depth = lambda part: [len(x) - len(x.lstrip(" :+-")) for x in plan if part in x]
        inner = depth("Join Inner")
        assert inner and not depth("Join LeftSemi") and min(depth("Generate")) > min(depth("Aggregate [term")) > min(inner)
        assert {r["term"]: r["n"] for r in counted.collect()} == {w: sum(w in words(t) for t in {t for _, t in corpus() if t}) for w in ("vexley", "word1")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_texts_of_many_spans(spark):
    """Positions and replacements over several blocks of spans."""
    rows = [(1, "é a@b.cd, " * 1000 + "end"), (2, "x 1.2.3.4 +49 30 1234567 " * 300)]
    got = {r["doc_id"]: r["base"] for r in found(spark, rows)}
    for i, text in rows:
        assert got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text))
    df = spark.createDataFrame(rows + [(3, "a@b.cd " * 40000)], "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean == {1: "é [EMAIL], " * 1000 + "end", 2: "x [IP] [PHONE] " * 300, 3: "[EMAIL] " * 40000}


def test_sanitise(spark):
    rows = [(1, "write to a@b.cd or 1.2.3.4 now", "x"), (2, None, "x"), (3, "", "x"), (None, "a@b.cd", "y"), (None, "a@b.cd", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, term string")
    out = pii.sanitise(df).collect()
    assert len(out) == 5 and out[0].__fields__ == df.columns
    by = {r["doc_id"]: r["text"] for r in out}
    assert by == {1: "write to [EMAIL] or [IP] now", 2: None, 3: "", None: "[EMAIL]"}


def test_overlaps_and_empty(spark):
    df = spark.createDataFrame([(1, "+1 4111 1111 1111 1111 1 2.2.2.2x")], "doc_id long, text string")
    # the phone run has too many digits; the card and the address stand
    assert pii.sanitise(df).first()["text"] == "+1 4111 1111 1111 1111 1 [IP]x"
    assert pii.sanitise(df.limit(0)).count() == 0


@pytest.mark.parametrize("value", ["", "a@b.cd"])
def test_hash_is_of_the_joined_spans(spark, value):
    df = spark.createDataFrame([(1, value)], "doc_id long, text string")
    got = pii.find(df).select(F.sha2(pii.joined(*pii.KINDS), 256).alias("h")).first()["h"]
    assert got == hashlib.sha256(("email:0:6" if value else "").encode()).hexdigest()


def test_own_letters_are_no_term(spark):
    rng = random.Random(1)
    filler = lambda: " ".join(f"w{rng.randrange(10**6)}x" for _ in range(20))
    rows = [(i, f"{filler()} write to zedzed@corpcorp.com {filler()}") for i in range(5)] + [(9 + i, filler()) for i in range(90)]
    assert all("zedzed" not in t and "corpcorp" not in t for t in terms_of(spark, rows))


def terms_of(spark, rows):
    said = dict(rows)
    for r in found(spark, rows):
        for kind, a, b in (x.split(":") for x in r["spans"].split(",") if x):
            if kind == "term":
                yield said[r["doc_id"]][int(a):int(b)]


def test_terms_nobody_wants_meet_no_join(spark):
    rows = spark.createDataFrame([(i, f"t{i % 40}-{i}") for i in range(40_000)] + [(-1, "shared"), (-2, "é"), (-3, None)], "i long, term string")
    wanted = spark.createDataFrame([("shared",), ("é",), ("t7-7",), ("t7-7",), ("nowhere",)], "term string")
    left = {r["term"] for r in rows.where(marked(wanted, "term")).collect()}
    assert {"shared", "é", "t7-7"} <= left and len(left) < 5_000, "about one bit in sixteen is set"
    assert rows.where(marked(wanted.limit(0), "term")).count() == 0
    many = rows.where("i % 3 = 0")
    assert many.exceptAll(rows.where(marked(many, "term"))).count() == 0
    # a join on the marks, above the explode, would make a row of every term of every text
    texts = spark.createDataFrame([("the shared words",), ("other words",)], "text string")
    counted = pii.counted_terms(texts, F.col("text"), wanted, "n")
    plan = counted._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda part: [len(x) - len(x.lstrip(" :+-")) for x in plan if part in x]
    assert min(depth("Join LeftOuter"), default=1_000) > min(depth("Generate"))
    assert {(r["term"], r["n"]) for r in counted.collect()} == {("shared", 1)}
