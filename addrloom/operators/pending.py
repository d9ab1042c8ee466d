"""Rows that have no vector yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrloom.operators.filters import valid_address


def unvectorized(addresses: DataFrame, vectors: DataFrame, id_column: str = "id") -> DataFrame:
    """Addresses (see ``sources.tables``) whose id, as text, is not in the vector
    table: an anti join that reads nothing but the ids of the vector table."""
    known = vectors.select(F.col("source_id").cast("string").alias("_known"))
    return addresses.join(known, F.col(id_column).cast("string") == F.col("_known"), "left_anti")


def unvectorized_count(addresses: DataFrame, vectors: DataFrame, id_column: str = "id") -> DataFrame:
    return unvectorized(addresses, vectors, id_column).agg(F.count("*").alias("pending_count"))


def valid_count(df: DataFrame, address: str) -> DataFrame:
    return df.where(valid_address(address)).agg(F.count("*").alias("valid_count"))
