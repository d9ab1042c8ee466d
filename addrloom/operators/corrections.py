"""Manual corrections merged into match rows.

Several corrections of one query are settled before the join (map-side
reduced), so each side of the join has one row per key on the correction side
and nothing fans out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom import vocab
from addrloom.operators.stats import side_by_side


def _as_exact(matches: DataFrame, hit: Column, values: dict[str, Column], source: str) -> list[Column]:
    fixed = {
        **values,
        "exact_match": F.lit(1.0),
        "partial_match": F.lit(0.0),
        "not_match": F.lit(0.0),
        "match_status": F.lit(vocab.EXACT),
        "correction_source": F.lit(source),
    }
    return [
        F.when(hit, fixed[c]).otherwise(F.col(f"m.{c}")).alias(c) if c in fixed else F.col(f"m.{c}")
        for c in matches.columns
    ]


def apply_picks(matches: DataFrame, picks: DataFrame, order: str | None = None) -> DataFrame:
    """Corrections picked from recall candidates: enterprise_id, standard_id,
    standard_address, room_no.  The last per query (by ``order``) counts and
    replaces all three values."""
    fields = ["standard_id", "standard_address", "room_no"]
    chosen = F.struct(
        F.col("standard_id").cast("string").alias("standard_id"),
        "standard_address",
        F.coalesce("room_no", F.lit("")).alias("room_no"),
    )
    rank = F.struct(*([order] if order else []), *fields)
    last = (
        picks.groupBy(F.col("enterprise_id").cast("string").alias("enterprise_id"))
        .agg(F.max_by(chosen, rank).alias("pick"))
    )
    joined = matches.alias("m").join(last.alias("c"), "enterprise_id", "left")
    values = {
        "address_id": F.col("c.pick.standard_id"),
        "standard_address": F.col("c.pick.standard_address"),
        "room_no": F.col("c.pick.room_no"),
    }
    return joined.select(*_as_exact(matches, F.col("c.pick").isNotNull(), values, vocab.SOURCE_PICKED))


def apply_edits(matches: DataFrame, edits: DataFrame, order: str | None = None) -> DataFrame:
    """Direct edits: enterprise_id, address_id, standard_address, room_no, where
    NULL keeps the stored value.  Edits of one query add up in ``order``: of each
    field the last one that is not NULL counts."""
    fields = ["address_id", "standard_address", "room_no"]

    def last(field: str) -> Column:
        value = F.col(field).cast("string")
        key = F.struct(*([order] if order else []), field)
        return F.max_by(value, F.when(value.isNotNull(), key)).alias(field)

    settled = edits.groupBy(F.col("enterprise_id").cast("string").alias("enterprise_id")).agg(
        F.lit(True).alias("edited"), *[last(f) for f in fields]
    )
    joined = matches.alias("m").join(settled.alias("c"), "enterprise_id", "left")
    values = {f: F.coalesce(F.col(f"c.{f}"), F.col(f"m.{f}")) for f in fields}
    return joined.select(*_as_exact(matches, F.col("c.edited").isNotNull(), values, vocab.SOURCE_EDITED))


def correction_report(matches: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections given, and match rows they touch."""
    given = corrections.agg(F.count("*").alias("correction_count"))
    keys = corrections.select(F.col("enterprise_id").cast("string").alias("enterprise_id"))
    touched = matches.join(keys, "enterprise_id", "left_semi").agg(F.count("*").alias("updated_rows"))
    return side_by_side(given, touched)
