"""Rows cut to those that may have a wanted key, before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# bits of the table, as a power of two: 4 MB at most
MOST_BITS = 25
_SLOT, _CELL, _MARKS = "_key_slot", "_key_cell", "_key_marks"


def _bit():
    return F.expr(f"shiftleft(1L, cast({_SLOT} % 64 as int))")


def _bits(keys: DataFrame) -> int:
    """Size of the table, a power of two."""
    return 1 << max(6, min(MOST_BITS, (16 * keys.count()).bit_length()))


def with_bit(rows: DataFrame, wanted: DataFrame, name: str, *columns: str) -> DataFrame:
    """The rows with a boolean ``name``: true for all whose ``columns`` are among those of ``wanted``, and for few others.

    A broadcast table of bits, at most ``2**MOST_BITS`` and 16 a wanted key where they are fewer, marks the wanted keys' hashes; a
    full table marks more rows, never fewer.
    """
    keys = wanted.select(*columns)
    bits = _bits(keys)
    slot = F.pmod(F.xxhash64(*columns), F.lit(bits))
    cell = F.expr(f"{_SLOT} div 64").alias(_CELL)
    marks = keys.select(slot.alias(_SLOT)).groupBy(cell).agg(F.bit_or(_bit()).alias(_MARKS))
    met = rows.withColumn(_SLOT, slot).withColumn(_CELL, cell).join(F.broadcast(marks), _CELL, "left")
    is_met = F.coalesce(F.col(_MARKS).bitwiseAND(_bit()) != 0, F.lit(False))
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], is_met.alias(name))


def within(rows: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """The rows, all of them whose ``columns`` are among those of ``wanted`` and few others: rows without a partner
    then stay out of the shuffle of the join that follows."""
    return with_bit(rows, wanted, "_met", *columns).where("_met").drop("_met")


def marked(wanted: DataFrame, column: str) -> Column:
    """Whether the row's ``column`` is among that of ``wanted``: true for all that are, and for few others.

    The same table of bits as one array, a scalar subquery that every task holds: a filter, which makes no row.
    """
    keys = wanted.select(column)
    bits = _bits(keys)
    slot = F.xxhash64(column).bitwiseAND(F.lit(bits - 1))
    marks = keys.select(slot.alias(_SLOT)).groupBy(F.expr(f"{_SLOT} div 64").alias(_CELL)).agg(F.bit_or(_bit()).alias(_MARKS))
    cells = wanted.sparkSession.range(bits // 64).withColumnRenamed("id", _CELL).join(marks, _CELL, "left")
    in_order = F.array_sort(F.collect_list(F.struct(_CELL, F.coalesce(_MARKS, F.lit(0)).alias(_MARKS))))
    table = cells.agg(F.transform(in_order, lambda c: c[_MARKS]).alias(_MARKS)).scalar()
    return F.getbit(F.get(table, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1
