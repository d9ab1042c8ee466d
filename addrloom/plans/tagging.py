"""Addresses to structured fields (modes '12', '17', '17_2')."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrloom import schemas
from addrloom.functions import entities as en
from addrloom.functions import text as tx
from addrloom.models.tagger import LevelWordTagger

MODES = ("12", "17", "17_2")


def to_entities(labelled: DataFrame, mode: str, address: str = "address") -> DataFrame:
    """Rows with ``tokens`` and ``labels`` to rows with ``entities``; the rule
    passes belong to the 12-level form only."""
    df = en.spans_to_entities(labelled)
    return en.apply_rules(df, address) if mode == "12" else df


def to_fields(df: DataFrame, mode: str, carry: list[str]) -> DataFrame:
    """``entities`` to the columns of the mode."""
    columns = en.FIELDS[mode](F.col("entities"))
    out = df.withColumn("dom_json", en.dom_json(F.col("entities"))) if mode != "12" else df
    kept = [*carry, *([] if mode == "12" else ["dom_json"])]
    return out.select(*kept, *[c.alias(name) for name, c in columns.items()])


def tag_addresses(
    df: DataFrame, address_column: str, mode: str = "17", id_column: str | None = None, tagger=None
) -> DataFrame:
    """``original_address`` and the fields of the mode for every row; the 17 forms
    also carry ``_id_field`` and ``dom_json``, and a plugged-in tagger its ``error``.  Blank addresses come out with
    empty fields.  Rows are independent: nothing is grouped or joined."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {MODES}")
    schemas.require_columns(df, address_column, id_column)
    address = tx.as_text(F.col(address_column))
    identifier = tx.as_text(F.col(id_column)) if id_column else F.lit("")
    # blank rows keep what they hold, others are stored stripped
    named = df.select(
        identifier.alias("_id_field"),
        F.when(tx.strip(address) == "", address).otherwise(tx.strip(address)).alias("original_address"),
        tx.strip(address).alias("address"),
    )
    labelled = (tagger or LevelWordTagger()).transform(named)
    carry = ["original_address"] if mode == "12" else ["_id_field", "original_address"]
    carry += [c for c in labelled.columns if c == "error"]
    return to_fields(to_entities(labelled, mode), mode, carry)
