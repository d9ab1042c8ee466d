"""Keeping costly columns from being computed again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the named columns passed through a one-element
    ``inline``.  Catalyst does not push filters on these columns, or merge
    projections, across it, so their expressions run once per row instead of
    once per later mention."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*kept, F.inline(F.array(F.struct(*names)))).select(*[F.col(f"`{c}`") for c in df.columns])
