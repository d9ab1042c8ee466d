"""Scores of two address columns of one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrloom.functions import text as tx
from addrloom.functions.scores import match_status
from addrloom.models.pair_scorer import LogitPairScorer
from addrloom.sources.tables import address_pairs


def match_pairs(
    df: DataFrame, address_a: str, address_b: str, id_column: str | None = None, scorer=None
) -> DataFrame:
    """identifier, both addresses, three scores and status for every row; with a
    plugged-in model also its ``error``.

    Rows with a blank address get 0 / 0 / 1 without being scored.  With a native
    scorer they simply pass through; a plugged-in model is shown the other rows
    only, in a branch of its own.
    """
    pairs = address_pairs(df, address_a, address_b, id_column).select(
        tx.null_if_empty(tx.as_text(F.col("identifier"))).alias("identifier"),
        tx.as_text(F.col("address_a")).alias("address_a"),
        tx.as_text(F.col("address_b")).alias("address_b"),
    )
    scorer = scorer or LogitPairScorer()
    blank = tx.is_blank(F.col("address_a")) | tx.is_blank(F.col("address_b"))
    verdict = {"exact_match": 0.0, "partial_match": 0.0, "not_match": 1.0}
    if isinstance(scorer, LogitPairScorer):
        scored = scorer.transform(pairs).withColumn("_blank", blank)
        scored = scored.withColumns(
            {c: F.when(F.col("_blank"), F.lit(v)).otherwise(F.col(c)) for c, v in verdict.items()}
        )
    else:
        fixed = pairs.where(blank).withColumns({c: F.lit(v) for c, v in verdict.items()})
        scored = scorer.transform(pairs.where(~blank)).unionByName(fixed, allowMissingColumns=True)
    return scored.select(
        "identifier", "address_a", "address_b", "exact_match", "partial_match", "not_match",
        match_status(F.col("exact_match"), F.col("partial_match"), F.col("not_match")).alias("match_status"),
        *[c for c in scored.columns if c == "error"],
    )
