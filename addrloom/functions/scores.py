"""Column expressions over the three class scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from addrloom.vocab import CLASS_NAMES, EXACT, NOT_MATCHED, PARTIAL


def match_status(exact: Column, partial: Column, not_match: Column | None = None) -> Column:
    """Name of the largest raw score; on ties exact wins over partial over none."""
    none = F.lit(0.0) if not_match is None else not_match
    return (
        F.when(exact >= F.greatest(partial, none), EXACT).when(partial >= none, PARTIAL).otherwise(NOT_MATCHED)
    )


def round2(score: Column) -> Column:
    """Two digits, halves to the even digit."""
    return F.bround(score, 2)


def softmax3(not_match: Column, partial: Column, exact: Column) -> dict[str, Column]:
    """Probabilities from three logits, shifted by the largest for safety."""
    top = F.greatest(not_match, partial, exact)
    parts = [F.exp(z - top) for z in (not_match, partial, exact)]
    whole = parts[0] + parts[1] + parts[2]
    return {name: part / whole for name, part in zip(CLASS_NAMES, parts)}


def class_name(index: Column) -> Column:
    """0 none, 1 partial, 2 exact; NULL for any other index."""
    names = F.array(*[F.lit(n) for n in CLASS_NAMES])
    return F.when(index.between(0, len(CLASS_NAMES) - 1), F.get(names, index))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
