"""Corrections merged into a stored match table.

The table is kept as published versions in cells of the enterprise id.  A merge reads the cells that its corrections fall in, writes
them anew, and leaves all others as they are; who reads meanwhile reads the version before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom.operators import corrections as co
from addrloom.sources import snapshots, tables

KEY = "enterprise_id"


def store_matches(matches: DataFrame, path: str, cells: int = snapshots.CELLS) -> snapshots.Version:
    """Match rows, in table layout, as a new version of a stored match table."""
    return snapshots.publish(tables.match_rows(matches), path, KEY, cells)


def _merge(spark: SparkSession, path: str, given: DataFrame, change: Callable[[DataFrame], DataFrame], token: str | None) -> snapshots.Version:
    if token and snapshots.has(spark, path, token):
        return snapshots.version(spark, path)
    return snapshots.rewrite(spark, path, given.select(F.col(KEY).cast("string").alias(KEY)), change, token)


def merge_picks(spark: SparkSession, path: str, picks: DataFrame, order: str | None = None, token: str | None = None) -> snapshots.Version:
    """Corrections picked from recall candidates (see ``operators.corrections.apply_picks``) merged into the stored rows.  Corrections of
    ids that are not stored change nothing.  A ``token`` names the merge: repeated, it counts once."""
    return _merge(spark, path, picks, lambda rows: co.apply_picks(rows, picks, order), token)


def merge_edits(spark: SparkSession, path: str, edits: DataFrame, order: str | None = None, token: str | None = None) -> snapshots.Version:
    """Direct edits (see ``operators.corrections.apply_edits``) merged into the stored rows, likewise."""
    return _merge(spark, path, edits, lambda rows: co.apply_edits(rows, edits, order), token)
