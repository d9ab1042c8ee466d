"""Shards against plain prefix sums."""

from __future__ import annotations

import zlib

from addrloom.llm import sharding

SCHEMA = "doc_id long, text string, shard string, size string, part string"


def plain(rows, shards):
    """(id, size, crc) in order with shard and slot."""
    sized = []
    for doc, text in rows:
        said = (text or "").encode()
        sized.append((doc, len(said) + 16, zlib.crc32(said) if text is not None else None))
    sized.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2] is not None, r[2] or 0, r[1]))
    total, before, seen, out = sum(r[1] for r in sized), 0, {}, []
    for r in sized:
        shard = before * shards // total
        out.append((*r, shard, seen.setdefault(shard, 0)))
        seen[shard] += 1
        before += r[1]
    return out


def check(spark, rows, shards, parts):
    df = spark.createDataFrame([(d, t, "a", "b", "c") for d, t in rows], SCHEMA).repartition(parts)
    got = sorted((tuple(r) for r in sharding.shard_rows(df, shards).collect()), key=lambda r: (r[3], r[4]))
    want = sorted(plain(rows, shards), key=lambda r: (r[3], r[4]))
    assert got == want
    return got


def test_equal_bytes(spark):
    rows = [(i * 7 % 501, "é" * (i * 13 % 97)) for i in range(501)]
    got = check(spark, rows, 40, 5)
    sizes = [sum(r[1] for r in got if r[3] == s) for s in range(40)]
    assert max(sizes) - min(sizes) <= 2 * max(r[1] for r in got)


def test_nulls_repeats_and_giants(spark):
    rows = [(None, None), (None, "x"), (None, ""), (5, None), (5, ""), (6, "y" * 50000)] + [(9, "same")] * 300 + [(10, None)] * 3
    check(spark, rows, 7, 3)
    check(spark, [(1, None)], 40, 1)


def test_empty_and_written(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}", "a", "b", "c") for i in range(200)], SCHEMA)
    assert sharding.shard_rows(df.limit(0), 3).count() == 0
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(back) == 200 and {r["text"] for r in back} == {f"text {i}" for i in range(200)}
    for shard in range(4):
        assert sorted(r["slot"] for r in back if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in back)))
