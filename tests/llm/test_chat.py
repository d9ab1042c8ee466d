"""Conversation collapse against comparing all conversations with each other."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from addrloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, copies string"


def plain(convs):
    said = {c: tuple(t) for c, t in convs.items()}
    kept = {}
    for c, t in said.items():
        if any(len(o) > len(t) and o[: len(t)] == t for o in said.values()):
            continue
        kept.setdefault(t, []).append(c)
    return {min(v): (len(v), len(t)) for t, v in kept.items()}


def check(spark, convs, shuffle=None, **options):
    rows = [(c, i, r, t, "x", "y") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    if shuffle:
        df = df.repartition(shuffle)
    out = chat.collapse(df, **options).collect()
    got = {r["conv_id"]: (r["copies"], r["n_turns"]) for r in out}
    assert got == plain(convs)
    return out


def test_snapshots_copies_and_branches(spark):
    base = [("user", f"q{i}") if i % 2 == 0 else ("assistant", f"a{i}") for i in range(9)]
    convs = {i: base[: i + 1] for i in range(9)}
    convs |= {20: base[:4] + [("user", "other")], 21: base[:4], 22: base, 23: [("user", "q0"), ("assistant", None)], 24: [("user", "q0"), ("assistant", "")]}
    convs |= {30: [(None, "q0")], 31: [("q0", None)], 32: [("", "")], 33: [(None, None)], 34: [("", "<|im_end|>")]}
    out = check(spark, convs)
    text = {r["conv_id"]: r["rendered"] for r in out}
    assert text[8].startswith("<|im_start|>user\nq0<|im_end|>\n<|im_start|>assistant\na1<|im_end|>")
    assert text[34] == "<|im_start|>unknown\n< |im_end|><|im_end|>"
    assert text[33].startswith("<|im_start|>unknown\n<")


def test_long_conversations_cross_partitions(spark):
    rng = random.Random(5)
    long = [(rng.choice("ua"), str(rng.random())) for _ in range(3000)]
    convs = {5: long, 6: long[:2500], 7: long[:1], 8: long[1:], 9: long[:2999] + [("u", "x")]} | {100 + i: [("u", str(i % 5))] for i in range(50)}
    out = check(spark, convs, shuffle=7, turns_per_part=100)
    parts = sorted((r["part"], r["rendered"]) for r in out if r["conv_id"] == 5)
    assert "\n".join(t for _, t in parts) == "\n".join(f"<|im_start|>{r}\n{t}<|im_end|>" for r, t in long)


def test_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([(None, 0, "u", "x"), (1, None, "u", "a"), (1, 0, "u", "b"), (1, 0, "u", "c"), (1, 0, "u", "c"), (2, 0, "u", "a")],
                               "conv_id long, turn long, role string, text string")
    out = chat.collapse(df).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in out] == [(1, 4)] and out[0]["rendered"].startswith("<|im_start|>u\na<")
    assert chat.collapse(df.where(F.lit(False))).count() == 0
