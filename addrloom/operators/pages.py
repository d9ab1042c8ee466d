"""Pages of result tables.  Every order ends with a business key, so that pages
neither overlap nor depend on storage order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.operators import filters as flt


def page(df: DataFrame, order: Sequence[Column | str], number: int = 1, size: int = 20) -> DataFrame:
    """A page of rows in ``order``.  The rows before it go through one task: for deep pages store the
    result (``page_store``) or go on from the last row (:func:`page_after`)."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_after(df: DataFrame, keys: Sequence[str], last: Sequence | None = None, size: int = 20) -> DataFrame:
    """The page that follows the key values ``last`` (None: the first page), in ascending order of
    the keys: any depth costs one page per partition, as the rows before are filtered out."""
    if last is not None:
        later = F.lit(False)
        for i in reversed(range(len(keys))):
            key, value = F.col(keys[i]), F.lit(last[i])
            later = (key > value) | ((key == value) & later)
        df = df.where(later)
    return df.orderBy(*keys).limit(size)


def _recall_order() -> list[Column]:
    return [F.asc("enterprise_id"), F.desc("similarity"), F.asc("standard_id")]


def _score_order(*keys: str) -> list[Column]:
    return [F.desc("exact_match"), F.desc("partial_match"), *[F.asc(k) for k in keys]]


def match_order() -> list[Column]:
    return _score_order("enterprise_id")


def recall_page(recall: DataFrame, filters: flt.Filters = None, number: int = 1, size: int = 20) -> DataFrame:
    return page(recall.where(flt.recall_filter(filters)), _recall_order(), number, size)


def recall_of(recall: DataFrame, ids) -> DataFrame:
    return flt.by_ids(recall, ids).orderBy(*_recall_order())


def match_rows(matches: DataFrame, filters: flt.Filters = None) -> DataFrame:
    return matches.where(flt.match_filter(filters)).orderBy(*match_order())


def match_page(matches: DataFrame, filters: flt.Filters = None, number: int = 1, size: int = 20) -> DataFrame:
    return page(matches.where(flt.match_filter(filters)), match_order(), number, size)


def pair_page(pairs: DataFrame, filters: flt.Filters = None, number: int = 1, size: int = 20) -> DataFrame:
    kept = pairs.where(flt.pair_filter(filters))
    return page(kept, _score_order("identifier", "address_a", "address_b"), number, size)


def tagged_page(
    tagged: DataFrame, filters: flt.Filters = None, mode: str = "12", number: int = 1, size: int = 20,
    order: Sequence[Column | str] | None = None,
) -> DataFrame:
    if order is None:
        order = ["_id_field", "original_address"] if "_id_field" in tagged.columns else ["original_address"]
    return page(tagged.where(flt.tagged_filter(filters, mode)), order, number, size)


def page_info(rows: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """One row: row count, page count (at least 1), first and last row shown."""
    total = F.count("*")
    first = F.lit((max(number, 1) - 1) * size + 1)
    return rows.agg(total.alias("total_count")).select(
        "total_count",
        F.greatest(F.ceil(F.col("total_count") / size), F.lit(1)).cast("long").alias("page_count"),
        first.cast("long").alias("first_row"),
        F.least(F.col("total_count"), F.lit(max(number, 1) * size)).cast("long").alias("last_row"),
    )
