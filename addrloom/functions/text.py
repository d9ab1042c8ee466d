"""Text clean-up and address wording tests."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from addrloom.vocab import AREA_SUFFIXES, BUILDING_SUFFIXES, ROOM_SUFFIXES

# fixed values: characters counted as blank at the ends of a text
BLANKS = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


# the same, one by one
BLANK_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{BLANKS}]", c))


def strip(text: Column) -> Column:
    # a pattern would try every character of a long text
    return F.btrim(text, F.lit(BLANK_CHARACTERS))


def as_text(value: Column) -> Column:
    """Text form of any value, '' for NULL."""
    return F.coalesce(value.cast("string"), F.lit(""))


def is_blank(text: Column) -> Column:
    """NULL, empty, or nothing but blanks."""
    return strip(as_text(text)) == ""


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def ends_with_any(text: Column, suffixes: Iterable[str]) -> Column:
    return text.rlike("(" + "|".join(suffixes) + r")\z")


def is_building(text: Column) -> Column:
    return ends_with_any(text, BUILDING_SUFFIXES)


def is_room(text: Column) -> Column:
    return ends_with_any(text, ROOM_SUFFIXES)


def is_area(text: Column) -> Column:
    return ends_with_any(text, AREA_SUFFIXES)


def characters(text: Column) -> Column:
    """The characters of a text, in order; an empty text has none."""
    return F.filter(F.split(text, ""), lambda c: c != "")
