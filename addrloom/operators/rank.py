"""From scored candidates to one verdict per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.functions.scores import match_status, round2
from addrloom.operators.recall import ENTERPRISE
from addrloom.vocab import NOT_MATCHED, RANK_THRESHOLD, SOURCE_AUTO

POLICIES = ("rounded", "raw")


def passes(threshold: float | None, similarity: str = "similarity") -> Column:
    """Candidate filter before ranking; a missing similarity counts as 1, and a
    threshold of 0 or less lets everything pass."""
    if threshold is None or threshold <= 0:
        return F.lit(True)
    return F.coalesce(F.col(similarity), F.lit(1.0)) >= threshold


def score(recall: DataFrame, scorer) -> DataFrame:
    """Add the three scores of (query address, candidate address)."""
    paired = recall.withColumns(
        {
            "address_a": F.coalesce("enterprise_address", F.lit("")),
            "address_b": F.coalesce("standard_address", F.lit("")),
        }
    )
    return scorer.transform(paired).drop("address_a", "address_b")


def _preference(policy: str) -> list[Column]:
    if policy == "rounded":
        return [
            F.desc(round2(F.col("exact_match"))),
            F.desc(round2(F.col("partial_match"))),
            F.asc(round2(F.col("not_match"))),
        ]
    if policy == "raw":
        return [F.desc("exact_match"), F.asc("not_match")]
    raise ValueError(f"unknown policy {policy!r}, expected one of {POLICIES}")


def pick_best(
    scored: DataFrame,
    policy: str = "rounded",
    threshold: float | None = None,
    queries: DataFrame | None = None,
) -> DataFrame:
    """The best candidate of each query, as match rows.

    A query is its id, name and address, so rows that share an id keep their own verdicts.  Equal scores go to the more similar, then to the smaller id.  A query whose
    candidates all fail the threshold gets the no-candidate verdict; so do the
    rows of ``queries`` (enterprise columns) that have no candidate row at all.
    ``threshold`` None means the default, 0 means off.

    The threshold is the first sort key rather than a filter, so one shuffle
    (cut to one row per query and input partition beforehand) does it all.
    """
    best = best_of(scored, policy, threshold)
    if queries is not None:
        everyone = queries.select(*[F.col(c).cast("string").alias(c) for c in ENTERPRISE])
        best = best.withColumnsRenamed({c: f"_{c}" for c in ENTERPRISE})
        same = [everyone[c].eqNullSafe(best[f"_{c}"]) for c in ENTERPRISE]
        best = everyone.join(best, same, "left")
    return verdicts(best)


def best_of(
    scored: DataFrame, policy: str = "rounded", threshold: float | None = None, query: tuple[str, ...] = ENTERPRISE,
) -> DataFrame:
    """The best scored row of each query, which the columns ``query`` tell apart, with ``_usable``: it passes."""
    threshold = RANK_THRESHOLD if threshold is None else threshold
    usable = passes(threshold) & F.coalesce(F.col("standard_id") != "", F.lit(False))
    order = Window.partitionBy(*query).orderBy(
        F.desc("_usable"), *_preference(policy), F.desc("similarity"), F.asc("standard_id")
    )
    ranked = scored.withColumn("_usable", usable).withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") == 1)


def verdicts(best: DataFrame) -> DataFrame:
    """Match rows from the best row of each query; where it is not usable, or none, the no-candidate verdict."""
    kept = F.coalesce(F.col("_usable"), F.lit(False))
    status = match_status(F.col("exact_match"), F.col("partial_match"), F.col("not_match"))
    return best.select(
        *ENTERPRISE,
        F.when(kept, F.col("standard_id")).alias("address_id"),
        F.when(kept, F.col("standard_address")).alias("standard_address"),
        F.when(kept, F.coalesce("room_no", F.lit(""))).otherwise("").alias("room_no"),
        F.when(kept, F.col("partial_match")).otherwise(0.0).alias("partial_match"),
        F.when(kept, F.col("exact_match")).otherwise(0.0).alias("exact_match"),
        F.when(kept, F.col("not_match")).otherwise(1.0).alias("not_match"),
        F.when(kept, status).otherwise(NOT_MATCHED).alias("match_status"),
        F.lit(SOURCE_AUTO).alias("correction_source"),
        # why a plugged-in model could not score the chosen candidate
        *[F.when(kept, F.col(c)).alias(c) for c in best.columns if c == "error"],
    )
