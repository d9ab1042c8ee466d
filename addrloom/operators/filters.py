"""Result filters from plain dictionaries, as one predicate to push down."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.vocab import SOURCE_LABELS

Filters = Mapping[str, Any] | None

_MATCH_TEXT = ("enterprise_name", "enterprise_address", "standard_address")
_PAIR_TEXT = ("address_a", "address_b")
_TAGGED_12_TEXT = ("original_address", "province", "city", "district", "road", "area")
_TAGGED_17_TEXT = ("original_address", "prov", "city", "district", "road", "poi")


def _all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def keyword(columns: Sequence[str], word: str) -> Column:
    """Any column LIKE %word%; % and _ in the word stay wildcards, a backslash takes the
    next character as it is."""
    pattern = re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], f"%{word}%", flags=re.DOTALL)
    return reduce(lambda a, b: a | b, [F.col(c).like(pattern) for c in columns])


def filled(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def valid_address(column: str) -> Column:
    return filled(column)


def _scores(filters: Mapping[str, Any]) -> list[Column]:
    """min is skipped when 0 or absent, max when absent or 1 and more."""
    out = []
    for name in ("exact_match", "partial_match", "not_match"):
        if filters.get(f"min_{name}"):
            out.append(F.col(name) >= float(filters[f"min_{name}"]))
        most = filters.get(f"max_{name}")
        if most is not None and most < 1.0:
            out.append(F.col(name) <= float(most))
    return out


def _status_and_scores(filters: Mapping[str, Any], text: Sequence[str]) -> list[Column]:
    out = []
    if filters.get("match_status"):
        out.append(F.col("match_status") == filters["match_status"])
    out += _scores(filters)
    if filters.get("keyword"):
        out.append(keyword(text, filters["keyword"]))
    return out


def match_filter(filters: Filters = None) -> Column:
    filters = filters or {}
    conditions = _status_and_scores(filters, _MATCH_TEXT)
    source = filters.get("correction_source")
    if source:
        conditions.append(F.col("correction_source") == SOURCE_LABELS.get(source, source))
    return _all_of(conditions)


def pair_filter(filters: Filters = None) -> Column:
    return _all_of(_status_and_scores(filters or {}, _PAIR_TEXT))


def recall_filter(filters: Filters = None) -> Column:
    filters = filters or {}
    conditions = []
    if filters.get("keyword"):
        conditions.append(keyword(_MATCH_TEXT, filters["keyword"]))
    least, most = filters.get("min_similarity"), filters.get("max_similarity")
    if least is not None and least > 0:
        conditions.append(F.col("similarity") >= float(least))
    if most is not None and most < 1.0:
        conditions.append(F.col("similarity") <= float(most))
    return _all_of(conditions)


def tagged_filter(filters: Filters = None, mode: str = "12") -> Column:
    filters = filters or {}
    conditions = []
    if filters.get("keyword"):
        conditions.append(keyword(_TAGGED_12_TEXT if mode == "12" else _TAGGED_17_TEXT, filters["keyword"]))
    levels = ("province", "city", "district") if mode == "12" else ("province",)
    for level in levels:
        if filters.get(f"has_{level}"):
            conditions.append(filled("prov" if mode != "12" else level))
    return _all_of(conditions)


def by_ids(df: DataFrame, ids: DataFrame | Sequence[Any], column: str = "enterprise_id") -> DataFrame:
    """Rows whose id is listed.  A short Python list becomes an IN predicate; a
    table of ids (any size) a semi join.  An empty list gives no rows."""
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).cast("string").alias(column))
        return df.join(wanted, column, "left_semi")
    return df.where(F.col(column).isin([str(i) for i in ids])) if ids else df.where(F.lit(False))


def count_like(df: DataFrame, column: str, patterns: Mapping[str, str]) -> DataFrame:
    """One row: rows per LIKE pattern, e.g. of evaluation id prefixes."""
    return df.agg(*[F.count_if(F.col(column).like(p)).alias(name) for name, p in patterns.items()])


def without_like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Drop the rows of a LIKE pattern (NULL ids stay), before a reload."""
    return df.where(~F.coalesce(F.col(column).like(pattern), F.lit(False)))
