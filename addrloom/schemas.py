"""Table layouts and alignment of older tables to them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from addrloom import vocab


def _layout(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


_text, _real, _when = T.StringType(), T.DoubleType(), T.TimestampType()
_vector = T.ArrayType(T.FloatType())

QUERY_VECTORS = _layout(
    ("source_id", _text), ("enterprise_name", _text), ("address", _text), ("vector", _vector), ("created_at", _when)
)
REFERENCE_VECTORS = _layout(
    ("source_id", _text), ("address", _text), ("room_no", _text), ("vector", _vector), ("created_at", _when)
)
VECTORS = {"enterprise": QUERY_VECTORS, "standard": REFERENCE_VECTORS}
RECALL = _layout(
    ("enterprise_id", _text), ("enterprise_name", _text), ("enterprise_address", _text),
    ("standard_id", _text), ("standard_address", _text), ("room_no", _text),
    ("similarity", _real), ("created_at", _when),
)
MATCH = _layout(
    ("enterprise_id", _text), ("enterprise_name", _text), ("enterprise_address", _text),
    ("address_id", _text), ("standard_address", _text), ("room_no", _text),
    ("partial_match", _real), ("exact_match", _real), ("not_match", _real),
    ("match_status", _text), ("correction_source", _text), ("created_at", _when),
)
PAIRS = _layout(
    ("identifier", _text), ("address_a", _text), ("address_b", _text),
    ("exact_match", _real), ("partial_match", _real), ("not_match", _real),
    ("match_status", _text), ("created_at", _when),
)
TAGGED_12 = _layout(
    ("original_address", _text), *[(f, _text) for f in vocab.FIELDS_12], ("created_at", _when)
)
TAGGED_17 = _layout(
    ("_id_field", _text), ("dom_json", _text), ("original_address", _text),
    *[(f, _text) for f in vocab.FIELDS_17], ("created_at", _when),
)
TAGGED_17_2 = _layout(
    ("_id_field", _text), ("dom_json", _text), ("original_address", _text),
    *[(f, _text) for f in vocab.FIELDS_34], ("created_at", _when),
)
TAGS = _layout(
    ("tag_name", _text), ("recall_table", _text), ("match_table", _text), ("created_at", _when), ("prefix", _text)
)
LOG = _layout(("id", T.LongType()), ("level", _text), ("message", _text), ("created_at", _when))

TAGGED = {"12": TAGGED_12, "17": TAGGED_17, "17_2": TAGGED_17_2}

# what a column holds when an older table lacks it or a run left it NULL
RECALL_DEFAULTS: dict[str, Any] = {"room_no": ""}
MATCH_DEFAULTS: dict[str, Any] = {
    "partial_match": 0.0, "exact_match": 0.0, "not_match": 0.0,
    "match_status": vocab.NOT_MATCHED, "correction_source": vocab.SOURCE_AUTO,
}
PAIR_DEFAULTS: dict[str, Any] = {
    "exact_match": 0.0, "partial_match": 0.0, "not_match": 0.0, "match_status": vocab.NOT_MATCHED
}


def tagged_defaults(mode: str) -> dict[str, Any]:
    blank = {f.name: "" for f in TAGGED[mode] if f.name not in ("original_address", "created_at", "dom_json")}
    if mode != "12":
        blank["dom_json"] = "[]"
    return blank


def align(df: DataFrame, layout: T.StructType, defaults: dict[str, Any] | None = None) -> DataFrame:
    """Bring ``df`` to ``layout``: missing columns appear with their default,
    existing ones are cast (``real`` becomes ``double``), others are dropped."""
    defaults = defaults or {}
    present = set(df.columns)

    def column(field: T.StructField) -> Column:
        if field.name in present:
            return F.col(f"`{field.name}`").cast(field.dataType).alias(field.name)
        if field.name == "created_at":
            return F.current_timestamp().cast(field.dataType).alias(field.name)
        return F.lit(defaults.get(field.name)).cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in layout])


def fill(df: DataFrame, defaults: dict[str, Any]) -> DataFrame:
    """Replace NULL by the column's default."""
    return df.select(
        *[
            F.coalesce(F.col(f"`{c}`"), F.lit(defaults[c])).alias(c) if c in defaults else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def require_columns(df: DataFrame, *names: str | None) -> DataFrame:
    """Fail early, naming the columns that a caller asked for and ``df`` lacks."""
    missing = [n for n in names if n and n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    return df
