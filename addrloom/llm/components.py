"""Connected components of a link table, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.llm.shared import stored

MAX_ROUNDS = 60


def _smallest(edges: DataFrame) -> DataFrame:
    """Per node the smallest of its neighbours and itself, stored, so that the join on it
    has plain exchanges on both sides and a hot node's edges can be split."""
    return stored(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "component-smallest")


def _mark() -> tuple[Column, Column]:
    """Two numbers that tell edge sets apart."""
    return F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of the links ``(u, v)``.

    Alternates two steps until nothing changes, which takes about the logarithm of the longest path:
    every node hands its smallest neighbour to its larger neighbours, then to its smaller ones.  The
    number of edges never grows.  Each round is written to the shared folder, so the lineage stays short.
    Loops, nulls and repeated links are ignored; no links give no rows.
    """
    pair = links.where("u is not null and v is not null and u <> v")
    edges = stored(pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "component-edges")
    mark = edges.agg(*_mark()).first()
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "component-edges")
        small = large.join(_smallest(large), "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        edges = stored(small.distinct(), "component-edges")
        before, mark = mark, edges.agg(*_mark()).first()
        if mark == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
