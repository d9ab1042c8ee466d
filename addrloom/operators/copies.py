"""Source tables with the columns of their results joined on.

The result side is reduced to one row per address first, so a repeated address
neither multiplies rows nor makes the join quadratic; a hot address is then
many-to-one, which the adaptive skew join can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom import vocab
from addrloom.functions import text as tx

TAG_COLUMNS = {
    "12": vocab.FIELDS_12,
    "17": ("_id_field", "dom_json", *vocab.FIELDS_17),
    "17_2": ("_id_field", "dom_json", *vocab.FIELDS_34),
}


def _one_per_key(results: DataFrame, keys: dict[str, Column], columns: Sequence[str]) -> DataFrame:
    return (
        results.groupBy(*[k.alias(name) for name, k in keys.items()])
        .agg(F.min(F.struct(*columns)).alias("_r"))
        .where(" AND ".join(f"{name} IS NOT NULL" for name in keys))
    )


def with_tags(
    source: DataFrame, address: str, tagged: DataFrame, mode: str = "12",
    blank_unmatched: bool = False, exact_key: bool = False,
) -> DataFrame:
    """``source`` with the tagging columns of its address: a left join.

    Results store stripped addresses, so both sides are compared stripped;
    ``exact_key`` compares them as they are.  Unmatched rows get NULL, or '' with
    ``blank_unmatched`` (then only the address fields are added).
    """
    columns = [c for c in TAG_COLUMNS[mode] if not blank_unmatched or c not in ("_id_field", "dom_json")]
    key = (lambda c: c) if exact_key else tx.strip
    lookup = _one_per_key(tagged, {"_key": key(F.col("original_address"))}, columns)
    # the source stays inside one column, so none of its names can clash with the join's
    rows = source.select(F.struct(*[F.col(f"`{c}`") for c in source.columns]).alias("_s"), key(F.col(f"`{address}`").cast("string")).alias("_key"))
    value = lambda c: F.coalesce(F.col(f"_r.{c}"), F.lit("")) if blank_unmatched else F.col(f"_r.{c}")
    return rows.join(lookup, "_key", "left").select("_s.*", *[value(c).alias(c) for c in columns])


def with_pair_scores(source: DataFrame, address_a: str, address_b: str, results: DataFrame) -> DataFrame:
    """``source`` with scores and status of its two addresses; rows without a
    result (NULL addresses among them) get 0 / 0 / 0 and no match."""
    columns = [*vocab.SCORE_COLUMNS, "match_status"]
    lookup = _one_per_key(results, {"_a": F.col("address_a"), "_b": F.col("address_b")}, columns)
    rows = source.select(
        F.struct(*[F.col(f"`{c}`") for c in source.columns]).alias("_s"),
        F.col(f"`{address_a}`").cast("string").alias("_a"), F.col(f"`{address_b}`").cast("string").alias("_b"),
    )
    return rows.join(lookup, ["_a", "_b"], "left").select(
        "_s.*",
        *[F.coalesce(F.col(f"_r.{c}"), F.lit(0.0)).alias(c) for c in vocab.SCORE_COLUMNS],
        F.coalesce(F.col("_r.match_status"), F.lit(vocab.NOT_MATCHED)).alias("match_status"),
    )
