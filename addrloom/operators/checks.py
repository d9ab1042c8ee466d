"""Data-quality queries and set operations over address tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrloom.functions.vectors import cosine_from_l2, l2_norm, norm_is_off
from addrloom.vocab import NORM_TOLERANCE, SAME_ADDRESS_SIMILARITY


def off_norm(vectors: DataFrame, tolerance: float = NORM_TOLERANCE) -> DataFrame:
    """Rows of the whole table whose vector is missing or not of unit length."""
    return vectors.where(norm_is_off(F.col("vector"), tolerance)).select(
        "source_id", "address", l2_norm(F.col("vector")).alias("norm")
    )


def same_address_similarity(
    queries: DataFrame, references: DataFrame, least: float = SAME_ADDRESS_SIMILARITY
) -> DataFrame:
    """Equal addresses should have (nearly) equal vectors.  Every row of both tables
    (``side``) is compared with one reference row of its address, the one with the
    smallest id, so nothing is left out and the cost is linear: a hot address costs as
    many rows as it has, not all its pairs."""
    smallest = references.groupBy("address").agg(F.min("source_id").alias("standard_id"))
    one = (
        references.join(smallest, "address").where(F.col("source_id") == F.col("standard_id")).dropDuplicates(["address"])
        .select("address", "standard_id", F.col("vector").alias("standard_vector"))
    )
    row = lambda df, side: df.select("source_id", "address", "vector", F.lit(side).alias("side"))
    similarity = cosine_from_l2(F.col("vector"), F.col("standard_vector"))
    return row(queries, "query").unionByName(row(references, "reference")).join(one, "address").select(
        "source_id", "side", "address", "standard_id", similarity.alias("similarity"), (similarity > least).alias("ok")
    )


def repeated(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value occurs more than once."""
    several = df.groupBy(column).agg(F.count("*").alias("_n")).where("_n > 1").select(column)
    return df.join(several, column, "left_semi")


def all_addresses(*tables: DataFrame) -> DataFrame:
    """Rows of several address tables on top of each other."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def distinct_addresses(*columns: DataFrame) -> DataFrame:
    return all_addresses(*columns).distinct()


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values in both one-column tables, once each."""
    return a.intersect(b)


def unused(candidates: DataFrame, used: DataFrame, column: str) -> DataFrame:
    """Candidate rows whose value is not used yet."""
    return candidates.join(used.select(column), column, "left_anti")
