"""From token labels to address entities and structured fields.

One address is one row: its tokens, labels and entities are arrays of that
row, so everything here is row-local (no shuffle) and linear in the number of
tokens.  Entities are ``array<struct<tag,text>>``.

The helpers take and return DataFrames where an intermediate array is used
several times: naming it as a column keeps Catalyst from repeating its
expression inside a lambda.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from addrloom import vocab
from addrloom.functions import text as tx
from addrloom.functions.batches import small_batches
from addrloom.functions.once import computed_once

ENTITIES = "array<struct<tag:string,text:string>>"
ENTITY_LIST = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())]))
PLACES = T.StructType(
    [
        T.StructField("before", T.ArrayType(T.IntegerType())),
        T.StructField("start", T.ArrayType(T.IntegerType())),
        T.StructField("last", T.IntegerType()),
    ]
)

# Rows whose texts are Python objects at one time.
PLACED_AT_ONCE = 64
# Rows whose labels and tokens are numbers at one time.
SPANNED_AT_ONCE = 256
# what JSON spells otherwise
JSON_ESCAPED = r'["\\\x00-\x1F]'

# fixed values: wording patterns of the entity rules.  (?dU): digits and blanks
# of any script, and only \n ends a line.
SHORT_ORPHAN = r"(?dU)^[a-zA-Z]?\d{1,3}$"
TAIL_ROOM = r"(?dU)([a-zA-Z]?\s*\d{2,4}\s*(室|房|号)?)\s*$"
TAIL_UNIT = r"(?dU)(\d{1,4}\s*(室|房|号|铺))\s*$"
TAIL_NUMBER = r"(?dU)(\d{2,4})\s*$"
LEADING_ROOM_NUMBER = r"(?dU)^(\d{3,4})"
LATIN_OR_DIGITS = r"(?d)^[a-zA-Z0-9]+$"
TAIL_AFTER_ROOM = r"(?dU)^([a-zA-Z]?\s*\d{1,4}\s*(室|房|号|铺)?)"
TAIL_IS_ROOM = r"(?dU)^[a-zA-Z]?\s*\d{2,4}\s*(室|房|号)?\s*$"


def entity(tag: Column | str, text: Column) -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.struct(tag.alias("tag"), text.alias("text"))


def no_entities() -> Column:
    return F.array().cast(ENTITIES)


# ---------------------------------------------------------------------------
# tokens -> entities
# ---------------------------------------------------------------------------

def clean_tokens(df: DataFrame, tokens: str = "tokens", labels: str = "labels") -> DataFrame:
    """Drop special tokens (with their labels) and strip sub-word marks."""
    pair = F.filter(
        F.arrays_zip(F.col(tokens).alias("token"), F.col(labels).alias("label")),
        lambda p: ~p["token"].isin(*vocab.SPECIAL_TOKENS),
    )
    df = df.withColumn("_kept", pair)

    def unmarked(token: Column) -> Column:
        # most tokens carry no mark, and a pattern costs many times a look at the first character
        marked = token.startswith("#") | token.startswith("Ġ")
        return F.when(marked, F.regexp_replace(F.regexp_replace(token, "^#+", ""), "^Ġ+", "")).otherwise(token)

    return df.withColumns(
        {
            tokens: F.transform("_kept", lambda p: unmarked(p["token"])),
            labels: F.transform("_kept", lambda p: p["label"]),
        }
    ).drop("_kept")


def _spans_of(tokens: pa.Array, labels: pa.Array) -> pa.Array:
    """Entities of a few rows, see ``spans_to_entities``."""
    rows = len(labels)
    missing, wordless = (a.is_null().to_numpy(zero_copy_only=False) for a in (labels, tokens))
    n_labels, n_tokens = (a.value_lengths().fill_null(0).to_numpy().astype(np.int64) for a in (labels, tokens))
    coded = labels.flatten().dictionary_encode()
    names = [x or "" for x in coded.dictionary.to_pylist()] + [""]
    code = coded.indices.fill_null(len(names) - 1).to_numpy()
    # what every different label says: its type, whether it can continue one, which one it leaves open
    said = [x[2:] if x[:2] in ("B-", "I-", "E-", "S-") else "" for x in names]
    kinds = sorted({"", *said})
    kind = np.array([kinds.index(k) for k in said])
    continues = np.array([x[:2] in ("I-", "E-") for x in names])
    opens = np.array([k if x[:2] in ("B-", "I-") else -1 for x, k in zip(names, kind)])
    row = np.repeat(np.arange(rows), n_labels)
    first_label = np.cumsum(n_labels) - n_labels
    before = np.full(len(code), -1)
    before[1:] = opens[code[:-1]]
    before[first_label[n_labels > 0]] = -1
    outside = kind[code] == 0
    cut = np.flatnonzero(outside | ~(continues[code] & (before == kind[code])))
    # a span ends where the next one or an outside token of its row stands, the last one with the tokens
    cut_row, place = row[cut], cut - first_label[row[cut]]
    last = np.append(cut_row[1:] != cut_row[:-1], True)[: len(cut)]
    stop = np.where(last, n_tokens[cut_row], np.append(place[1:], 0)[: len(cut)])
    span = np.flatnonzero(~outside[cut])
    owner, start, stop = cut_row[span], place[span], stop[span]
    if (~wordless[owner] & (stop < start)).any():
        raise ValueError("more labels than tokens")
    start, stop = np.minimum(start, n_tokens[owner]), np.minimum(stop, n_tokens[owner])
    size = np.maximum(stop - start, 0)
    ends = np.cumsum(size)
    first_token = np.cumsum(n_tokens) - n_tokens
    taken = np.repeat(first_token[owner] + start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    parts = tokens.flatten().fill_null("").take(pa.array(taken))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), parts), "")
    if wordless.any():
        texts = pc.if_else(pa.array(wordless[owner]), pa.scalar(None, texts.type), texts)
    tags = pa.array(kinds, texts.type).take(pa.array(kind[code[cut[span]]]))
    bounds = np.append(0, np.cumsum(np.bincount(owner, minlength=rows)))
    return pa.ListArray.from_arrays(
        pa.array(bounds, pa.int32(), mask=np.append(missing, False)), pa.StructArray.from_arrays([tags, texts], names=["tag", "text"])
    )


@F.arrow_udf(ENTITY_LIST)
def _spans(tokens: pa.Array, labels: pa.Array) -> pa.Array:
    """Entities of a batch, ``SPANNED_AT_ONCE`` rows at a time."""
    made = [_spans_of(tokens.slice(i, SPANNED_AT_ONCE), labels.slice(i, SPANNED_AT_ONCE)) for i in range(0, len(labels), SPANNED_AT_ONCE)]
    return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())])))


def spans_to_entities(
    df: DataFrame, tokens: str = "tokens", labels: str = "labels", out: str = "entities"
) -> DataFrame:
    """Join B/I/E/S-labelled tokens into entities, in text order.

    B and S open an entity.  I and E continue the open one of the same type and
    open a new one otherwise.  E and S close it, and so does any other label.
    """
    small_batches(df.sparkSession)
    df = df.withColumn(out, _spans(F.col(tokens), F.col(labels)).cast(ENTITIES))
    return computed_once(df, out)


# ---------------------------------------------------------------------------
# rule passes over the entities of one address (12-level form only)
# ---------------------------------------------------------------------------

def retag_by_suffix(entities: Column) -> Column:
    """Room tags that name a building become ``subpoi``; building tags that name
    a room or an area become ``houseno`` or ``poi``; a short bare number or
    letter-number left as building becomes ``houseno``."""

    def new_tag(e: Column) -> Column:
        tag, text = e["tag"], e["text"]
        sub = tag == "subpoi"
        return (
            F.when((tag == "houseno") & tx.is_building(text), "subpoi")
            .when(sub & tx.is_room(text) & ~tx.is_building(text), "houseno")
            .when(sub & tx.is_area(text), "poi")
            .otherwise(tag)
        )

    fixed = F.transform(entities, lambda e: entity(new_tag(e), e["text"]))
    return F.transform(
        fixed,
        lambda e: entity(
            F.when((e["tag"] == "subpoi") & e["text"].rlike(SHORT_ORPHAN), "houseno").otherwise(e["tag"]), e["text"]
        ),
    )


def merge_adjacent(df: DataFrame, tag: str = "houseno", column: str = "entities") -> DataFrame:
    """Concatenate runs of neighbouring entities that all carry ``tag``."""
    df = df.withColumn(
        "_before",
        F.concat(
            F.array(F.lit("")),
            F.transform(F.slice(column, 1, F.greatest(F.size(column) - 1, F.lit(0))), lambda e: e["tag"]),
        ),
    )
    df = df.withColumn(
        "_start",
        F.filter(
            F.transform(
                F.arrays_zip(F.col(column).alias("e"), F.col("_before").alias("b")),
                lambda p, i: F.when((p["e"]["tag"] == tag) & (p["b"] == tag), 0).otherwise(i + 1),
            ),
            lambda at: at > 0,
        ),
    )
    df = df.withColumn(
        "_stop", F.concat(F.slice("_start", 2, F.greatest(F.size("_start"), F.lit(1))), F.array(F.size(column) + 1))
    )
    merged = F.zip_with(
        "_start", "_stop",
        lambda a, b: entity(
            F.element_at(F.col(column), a)["tag"],
            F.array_join(F.transform(F.slice(F.col(column), a, b - a), lambda e: e["text"]), ""),
        ),
    )
    return df.withColumn(
        column, F.when(F.size(column) > 0, merged.cast(ENTITIES)).otherwise(no_entities())
    ).drop("_before", "_start", "_stop")


@F.arrow_udf(PLACES)
def _places(address: pa.Array, texts: pa.Array) -> pa.Array:
    """Where the texts stand in the address, each searched from the end of the one
    found before: that end, the start (or the end again, if absent), and the end
    of the last one found.  Linear in the address, however long."""
    kind = pa.struct([("before", pa.list_(pa.int32())), ("start", pa.list_(pa.int32())), ("last", pa.int32())])
    pieces = [pa.array([], kind)]
    # a batch may hold megabytes of texts, each of them many times as large as a Python object
    for first in range(0, len(address), PLACED_AT_ONCE):
        rows = []
        for whole, parts in zip(address.slice(first, PLACED_AT_ONCE).to_pylist(), texts.slice(first, PLACED_AT_ONCE).to_pylist()):
            at, before, start = 0, [], []
            for part in parts:
                found = whole.find(part, at)
                before.append(at)
                start.append(max(found, at))
                if found >= 0:
                    at = found + len(part)
            rows.append({"before": before, "start": start, "last": at})
        pieces.append(pa.array(rows, kind))
    return pa.concat_arrays(pieces)


def _placed(df: DataFrame, address: str, column: str) -> DataFrame:
    small_batches(df.sparkSession)
    texts = F.transform(column, lambda e: e["text"])
    return computed_once(df.withColumn("_placed", _places(F.coalesce(address, F.lit("")), texts)), "_placed")


def _tail_room(tail: Column) -> Column:
    tries = [F.regexp_extract(tail, p, 0) for p in (TAIL_ROOM, TAIL_UNIT, TAIL_NUMBER)]
    return tx.strip(F.coalesce(*[F.nullif(t, F.lit("")) for t in tries]))


def absorb_tail(df: DataFrame, address: str = "address", column: str = "entities") -> DataFrame:
    """Give a room-like end of the address that no entity covers to ``houseno``."""

    df = _placed(df, address, column).withColumn("_end", F.col("_placed.last"))
    uncovered = F.when(
        F.col("_end") < F.char_length(address), _tail_room(tx.strip(F.substr(F.col(address), F.col("_end") + 1)))
    )
    df = df.withColumn("_room", uncovered)
    df = df.withColumn("_first", F.array_position(F.transform(column, lambda e: e["tag"]), F.lit("houseno")))
    appended = F.concat(F.col(column), F.array(entity("houseno", F.col("_room"))).cast(ENTITIES))
    extended = F.transform(
        column,
        lambda e, i: entity(
            e["tag"],
            F.when(i + 1 == F.col("_first"), F.concat(e["text"], F.col("_room"))).otherwise(e["text"]),
        ),
    )
    return df.withColumn(
        column,
        F.when(F.col("_room").isNull(), F.col(column))
        .when(F.col("_first") == 0, appended)
        .otherwise(extended.cast(ENTITIES)),
    ).drop("_placed", "_end", "_room", "_first")


def imply_floor(df: DataFrame, column: str = "entities") -> DataFrame:
    """Without a floor, read it off the first room number (601 -> 6, 1203 -> 12)
    and put it right after that room; then spell out the bare ground floor."""
    df = df.withColumn("_floored", F.exists(column, lambda e: e["tag"] == "floorno"))
    numbers = F.transform(
        column,
        lambda e: F.when(e["tag"] == "houseno", F.regexp_extract(e["text"], LEADING_ROOM_NUMBER, 1)).otherwise(""),
    )
    df = df.withColumn("_number", numbers)
    found = F.filter(F.transform("_number", lambda n, i: F.when(n != "", i).otherwise(-1)), lambda i: i >= 0)
    df = computed_once(
        df.withColumn("_at", F.when(F.col("_floored"), -1).otherwise(F.coalesce(F.get(found, F.lit(0)), F.lit(-1)))), "_at"
    )

    def with_floor(e: Column, i: Column) -> Column:
        number = F.element_at(F.col("_number"), i + 1)
        floor = F.when(F.char_length(number) == 3, F.substring(number, 1, 1)).otherwise(F.substring(number, 1, 2))
        return F.when(
            F.col("_at") == i, F.array(entity(e["tag"], e["text"]), entity("floorno", floor))
        ).otherwise(F.array(entity(e["tag"], e["text"])))

    df = df.withColumn(column, F.flatten(F.transform(column, with_floor)).cast(ENTITIES))
    spelled = F.transform(
        column,
        lambda e: entity(
            e["tag"],
            F.when((e["tag"] == "floorno") & (tx.strip(e["text"]) == "首"), "首层").otherwise(e["text"]),
        ),
    )
    return df.withColumn(column, spelled.cast(ENTITIES)).drop("_floored", "_number", "_at")


def expand_boundaries(df: DataFrame, address: str = "address", column: str = "entities") -> DataFrame:
    """Let room entities, and a bare ``号``, take in the unlabelled letters and
    digits right before them, and the last room (or a new one) the unlabelled
    end of the address."""

    df = _placed(df, address, column)

    def grown(pair: Column, i: Column) -> Column:
        e, before, start = pair["e"], pair["before"], pair["start"]
        gap = tx.strip(F.substr(F.col(address), before + 1, start - before))
        takes = (
            (i > 0)
            & (start > before)
            & ((e["tag"] == "houseno") | ((e["tag"] == "roadno") & (e["text"] == "号")))
            & gap.rlike(LATIN_OR_DIGITS)
        )
        return entity(e["tag"], F.when(takes, F.concat(gap, e["text"])).otherwise(e["text"]))

    zipped = F.arrays_zip(
        F.col(column).alias("e"), F.col("_placed.before").alias("before"), F.col("_placed.start").alias("start")
    )
    df = df.withColumn("_grown", F.transform(zipped, grown).cast(ENTITIES))
    df = df.withColumn(
        "_tail",
        F.when(
            F.col("_placed.last") < F.char_length(address),
            tx.strip(F.substr(F.col(address), F.col("_placed.last") + 1)),
        ).otherwise(""),
    )
    df = df.withColumn("_last", F.when(F.size("_grown") > 0, F.element_at("_grown", -1)))
    more = tx.strip(F.regexp_extract("_tail", TAIL_AFTER_ROOM, 0))
    body = F.slice("_grown", 1, F.greatest(F.size("_grown") - 1, F.lit(0)))
    longer = F.concat(body, F.array(entity("houseno", F.concat(F.col("_last.text"), more))).cast(ENTITIES))
    added = F.concat(F.col("_grown"), F.array(entity("houseno", F.col("_tail"))).cast(ENTITIES))
    return df.withColumn(
        column,
        F.when(F.col("_last").isNull() | (F.col("_tail") == ""), F.col("_grown"))
        .when(F.col("_last.tag") == "houseno", longer)
        .when(F.col("_tail").rlike(TAIL_IS_ROOM), added)
        .otherwise(F.col("_grown")),
    ).drop("_placed", "_grown", "_tail", "_last")


def apply_rules(df: DataFrame, address: str = "address", column: str = "entities") -> DataFrame:
    """All rule passes, in order."""
    df = df.withColumn(column, retag_by_suffix(F.col(column)).cast(ENTITIES))
    df = merge_adjacent(df, "houseno", column)
    df = absorb_tail(df, address, column)
    df = imply_floor(df, column)
    return computed_once(expand_boundaries(df, address, column), column)


# ---------------------------------------------------------------------------
# entities -> fields
# ---------------------------------------------------------------------------

def _joined(entities: Column, tags: Iterable[str]) -> Column:
    wanted = F.filter(entities, lambda e: e["tag"].isin(*tags))
    return F.array_join(F.transform(wanted, lambda e: e["text"]), "")


def fields_12(entities: Column) -> dict[str, Column]:
    return {f: _joined(entities, tags) for f, tags in vocab.TAGS_OF_FIELD_12.items()}


def fields_17(entities: Column) -> dict[str, Column]:
    return {f: _joined(entities, (f,)) for f in vocab.FIELDS_17}


def _texts_of(entities: Column, tag: str) -> Column:
    wanted = F.filter(entities, lambda e: (e["tag"] == tag) & (e["text"] != ""))
    return F.transform(wanted, lambda e: e["text"])


def fields_34(entities: Column) -> dict[str, Column]:
    """First value of a tag in its own column, the later ones joined in ``_2``."""
    out: dict[str, Column] = {}
    for f in vocab.FIELDS_17:
        texts = _texts_of(entities, f)
        out[f] = F.coalesce(F.get(texts, F.lit(0)), F.lit(""))
        out[f + "_2"] = F.array_join(F.slice(texts, 2, F.greatest(F.size(texts), F.lit(1))), "")
    return out


FIELDS = {"12": fields_12, "17": fields_17, "17_2": fields_34}


def _json_string(text: Column) -> Column:
    escaped = F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")
    return F.when(text.isNull() | text.rlike(JSON_ESCAPED), escaped).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def dom_json(entities: Column) -> Column:
    """``[["tag", "text"], ...]``, with a blank after each comma."""
    items = F.transform(
        entities,
        lambda e: F.concat(F.lit("["), _json_string(e["tag"]), F.lit(", "), _json_string(e["text"]), F.lit("]")),
    )
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
