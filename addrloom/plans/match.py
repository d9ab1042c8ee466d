"""Recall, ranking, and both together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom.models.pair_scorer import LogitPairScorer
from addrloom.operators import knn, rank
from addrloom.operators.centre_tree import CentreTree
from addrloom.operators.recall import ENTERPRISE, summary
from addrloom.operators.stats import match_stats
from addrloom.plans.vectorize import centres_path, encode
from addrloom.sources import tables
from addrloom.vocab import RANK_THRESHOLD, TOP_N


def recall(
    queries: DataFrame, references: DataFrame, top_n: int = TOP_N, threshold: float | None = None,
    centres: np.ndarray | CentreTree | None = None, probes: int | None = None,
) -> DataFrame:
    """Flat recall rows; approximate when the references are clustered (``centres``
    given and ``list_id`` present), exact otherwise."""
    return _found(queries, references, top_n, threshold, centres, probes).rows()


def _found(
    queries: DataFrame, references: DataFrame, top_n: int, threshold: float | None = None,
    centres: np.ndarray | CentreTree | None = None, probes: int | None = None,
) -> knn.Found:
    if centres is None:
        return knn.knn_found(queries, references, top_n, threshold)
    return knn.ivf_found(queries, references, centres, top_n, threshold, probes)


def rank_recall(
    recalled: DataFrame, scorer=None, policy: str = "rounded", threshold: float | None = None,
    queries: DataFrame | None = None,
) -> DataFrame:
    """Match rows from stored recall rows.  Only candidates that pass the threshold are
    shown to the scorer; the queries left without one are then put back."""
    threshold = RANK_THRESHOLD if threshold is None else threshold
    scorer = scorer or LogitPairScorer()
    if threshold <= 0:
        return rank.pick_best(rank.score(recalled, scorer), policy, threshold, queries)
    usable = F.coalesce(F.col("standard_id") != "", F.lit(False))
    scored = rank.score(recalled.where(rank.passes(threshold) & usable), scorer)
    if queries is None:
        queries = recalled.select(*ENTERPRISE).distinct()
    return rank.pick_best(scored, policy, threshold, queries)


def _rank_found(
    found: knn.Found, scorer=None, policy: str = "rounded", threshold: float | None = None, queries: DataFrame | None = None,
) -> DataFrame:
    """As :func:`rank_recall`, from pairs whose texts are not joined yet.  They are for the scorer alone; hashes stand for them in
    the ranking, and only the chosen pairs get them again."""
    threshold = RANK_THRESHOLD if threshold is None else threshold
    pairs = found.pairs
    if threshold > 0:
        pairs = pairs.where(rank.passes(threshold) & F.coalesce(F.col("standard_id") != "", F.lit(False)))
    scored = rank.score(found.with_texts(pairs), scorer or LogitPairScorer()).drop(*ENTERPRISE, "standard_address")
    best = rank.best_of(scored, policy, threshold, knn.QUERY_HASHES)
    hashes = list(knn.QUERY_HASHES)
    if queries is not None:
        everyone = knn.with_query_hashes(queries.select(*[F.col(c).cast("string").alias(c) for c in ENTERPRISE]))
        best = everyone.join(best, hashes, "left")
    elif threshold > 0:
        best = found.pairs.select(*hashes).distinct().join(found.asked(), hashes).join(best, hashes, "left")
    else:
        best = found.asked().join(best, hashes)
    # a query without a candidate meets no reference, and by its own hashes such queries stay dealt out
    best = best.withColumns({r: F.coalesce(r, q) for r, q in zip(knn.REFERENCE_HASHES, knn.QUERY_HASHES)})
    return rank.verdicts(best.join(found.told(), list(knn.REFERENCE_HASHES), "left"))


def enterprises(queries: DataFrame) -> DataFrame:
    """The enterprise columns of a query vector table."""
    return queries.select(
        F.col("source_id").cast("string").alias("enterprise_id"),
        F.col("enterprise_name").alias("enterprise_name"),
        F.col("address").alias("enterprise_address"),
    )


def two_stage(
    queries: DataFrame, references: DataFrame, top_n: int = TOP_N, threshold: float | None = None,
    scorer=None, policy: str = "rounded", rank_threshold: float | None = 0.0, keep_unmatched: bool = False,
    centres: np.ndarray | CentreTree | None = None, probes: int | None = None,
) -> DataFrame:
    """Vector tables to match rows.  A query without any recall row is missing
    from the result unless ``keep_unmatched``."""
    found = _found(queries, references, top_n, threshold, centres, probes)
    everyone = enterprises(queries) if keep_unmatched else None
    return _rank_found(found, scorer, policy, rank_threshold, everyone)


def run_recall(
    spark: SparkSession, query_table: str, reference_table: str, recall_table: str,
    top_n: int = TOP_N, threshold: float | None = None, probes: int | None = None,
) -> DataFrame:
    """Recall between two stored vector tables into a stored recall table
    (replaced); gives its summary.  Exact, or, with ``probes`` (0: by the number of lists), over
    that many lists of a reference table that ``vectorize`` stored as an index."""
    centres = None if probes is None else knn.load_centres(spark, centres_path(reference_table))
    found = recall(
        tables.read(spark, query_table), tables.read(spark, reference_table), top_n, threshold, centres, probes or None
    )
    tables.store(tables.recall_rows(found), recall_table)
    return summary(tables.read(spark, recall_table))


def run_ranking(
    spark: SparkSession, recall_table: str, match_table: str, scorer=None, policy: str = "rounded",
    threshold: float | None = None, query_table: str | None = None,
) -> DataFrame:
    """Rank a stored recall table into a stored match table (replaced); gives its
    statistics.  With ``query_table`` every query gets a row."""
    everyone = enterprises(tables.read(spark, query_table)) if query_table else None
    ranked = rank_recall(tables.read(spark, recall_table), scorer, policy, threshold, everyone)
    tables.store(tables.match_rows(ranked), match_table)
    return match_stats(tables.read(spark, match_table))


def run_two_stage(
    spark: SparkSession, query_table: str, reference_table: str, recall_table: str, match_table: str,
    top_n: int = TOP_N, threshold: float | None = None, scorer=None, policy: str = "rounded",
    rank_threshold: float | None = 0.0, keep_unmatched: bool = False, probes: int | None = None,
) -> DataFrame:
    """Both steps through stored tables.  The recall table in between is written
    before the ranking starts, so a failure there repeats the ranking only."""
    run_recall(spark, query_table, reference_table, recall_table, top_n, threshold, probes)
    return run_ranking(
        spark, recall_table, match_table, scorer, policy, rank_threshold, query_table if keep_unmatched else None
    )


def single_stage(
    addresses: DataFrame, references: DataFrame, top_n: int = TOP_N, encoder=None, scorer=None,
    rank_threshold: float | None = None,
) -> DataFrame:
    """Query addresses (id, name, address) to match rows: encode, search, rank.
    Every address gets a row.  The encoded queries are stored first, as the join reads its sides more than once."""
    queries = tables.written(encode(addresses, "enterprise", encoder), "encoded")
    everyone = addresses.select(
        F.col("id").alias("enterprise_id"), F.col("name").alias("enterprise_name"),
        F.col("address").alias("enterprise_address"),
    )
    return _rank_found(_found(queries, references, top_n), scorer, "rounded", rank_threshold, everyone)
