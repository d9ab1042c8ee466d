"""Recall results: flat rows (the canonical form), nested rows, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTERPRISE = ("enterprise_id", "enterprise_name", "enterprise_address")


def regroup(recall: DataFrame, top_n: int | None = None) -> DataFrame:
    """One row per query (id, name and address) with its candidates, most similar
    first, ties by id; rows without a candidate id give none.

    All candidates by default: recall rows hold a bounded number of them.  Where that is not
    sure, ``top_n`` nests the best of each query only and the flat rows stay the whole result; they are
    cut to ``top_n`` a query in every input partition before the one shuffle, so a hot query
    brings a task no more than ``top_n`` rows a partition.
    """
    candidate = F.struct(
        (-F.col("similarity")).alias("_order"),
        F.col("standard_id").alias("source_id"),
        F.col("standard_address").alias("address"),
        "room_no",
        "similarity",
    )
    usable = F.coalesce(F.col("standard_id") != "", F.lit(False))
    rows = recall.select(*ENTERPRISE, F.when(usable, candidate).alias("_candidate"))
    if top_n is not None:
        order = Window.partitionBy(*ENTERPRISE).orderBy(F.asc_nulls_last("_candidate"))
        rows = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top_n)
    grouped = rows.groupBy(*ENTERPRISE).agg(F.array_sort(F.collect_list("_candidate")).alias("candidates"))
    return grouped.select(*ENTERPRISE, F.transform("candidates", lambda c: c.dropFields("_order")).alias("candidates"))


def flatten(nested: DataFrame) -> DataFrame:
    """Nested candidates to one row each; a missing room becomes ''."""
    return nested.select(*ENTERPRISE, F.explode("candidates").alias("c")).select(
        *ENTERPRISE,
        F.col("c.source_id").cast("string").alias("standard_id"),
        F.col("c.address").alias("standard_address"),
        F.coalesce("c.room_no", F.lit("")).alias("room_no"),
        F.col("c.similarity").cast("double").alias("similarity"),
    )


def summary(recall: DataFrame) -> DataFrame:
    """Queries, rows, and rows that have a candidate."""
    return recall.agg(
        F.countDistinct("enterprise_id").alias("enterprise_count"),
        F.count("*").alias("recall_count"),
        F.count("standard_id").alias("candidate_count"),
    )
