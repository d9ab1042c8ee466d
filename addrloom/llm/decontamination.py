"""Benchmark passages in training documents, by a broadcast hash set of word windows.

The benchmark's windows are hashed into a sorted set that is broadcast to the tasks.  Each task
hashes every window of its documents with two running sums, looks them up, and compares the words of
every hit, so a hash collision decides nothing.  Documents are not shuffled.

The broadcast is bounded: a benchmark above ``block_bytes`` is taken in blocks, one pass over the
documents each, and the hits of the blocks are merged by the row they are in.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.llm.arrowtext import pieces, word_bounds
from addrloom.llm.shared import stored

WINDOW = 10
BLOCK_BYTES = 16 << 20
SPAN = ("first", "last", "start", "end")

# bytes of words: digits, letters (A-Z made small) and everything beyond ASCII
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_IS_WORD = _IS_WORD[_SMALL]

_BYTE_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so they have inverses


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Hasher:
    """Hashes of words and windows as differences of running sums, modulo 2**64."""

    def __init__(self) -> None:
        self.n = 0

    def _grow(self, n: int) -> None:
        if n > self.n:
            self.n = n
            self.p, self.p_back = _powers(_P, n), _powers(pow(_P, -1, 2**64), n)
            self.q, self.q_back = _powers(_Q, n), _powers(pow(_Q, -1, 2**64), n)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * self.p[: len(data)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.p_back[starts]

    def windows(self, words: np.ndarray, size: int) -> np.ndarray:
        n = len(words) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        self._grow(len(words) + 1)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.q[: len(words)], out=sums[1:])
        return (sums[size:] - sums[:n]) * self.q_back[:n]


def _tokens(data: np.ndarray, at: np.ndarray):
    small = _SMALL[data]
    return small, *word_bounds(_IS_WORD[data], at)


def _window_set(items: list[tuple[str, str]], window: int) -> dict[int, tuple]:
    """Per window size: a bitmap of leading hash bits, the sorted hashes, and the exact words and
    items behind each hash.  Plain values, as they are broadcast."""
    hasher = _Hasher()
    found: dict[int, dict[int, dict[bytes, set[str]]]] = {}
    for item, text in items:
        data = np.frombuffer(text.encode(), np.uint8)
        small, starts, ends, _ = _tokens(data, np.array([0, len(data)]))
        if not len(starts):
            continue
        size = min(window, len(starts))
        parts = [small[a:b].tobytes() for a, b in zip(starts, ends)]
        by_hash = found.setdefault(size, {})
        for i, h in enumerate(hasher.windows(hasher.words(small, starts, ends), size).tolist()):
            by_hash.setdefault(h, {}).setdefault(b" ".join(parts[i : i + size]), set()).add(item)
    out = {}
    for size, by_hash in found.items():
        keys = np.sort(np.array(list(by_hash), np.uint64))
        bitmap = np.zeros(1 << 20, bool)
        bitmap[keys >> np.uint64(44)] = True
        out[size] = (bitmap, keys, by_hash)
    return out


def _candidates(hashes: np.ndarray, bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    maybe = np.flatnonzero(bitmap[hashes >> np.uint64(44)])
    place = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
    return maybe[keys[place] == hashes[maybe]]


def _scan(batch: pa.RecordBatch, windows: dict[int, tuple], hasher: _Hasher, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Pieces of the batch with the hits of earlier blocks extended; only the named columns."""
    for piece, data, at in pieces(batch, "text"):
        small, starts, ends, row = _tokens(data, at)
        hashes = hasher.words(small, starts, ends)
        first_word = np.searchsorted(row, np.arange(piece.num_rows))
        spans: dict[int, list] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        for size, (bitmap, keys, exact) in windows.items():
            every = hasher.windows(hashes, size)
            found = _candidates(every, bitmap, keys)
            found = found[row[found] == row[found + size - 1]]
            for i, h in zip(found.tolist(), every[found].tolist()):
                said = b" ".join(small[a:b].tobytes() for a, b in zip(starts[i : i + size], ends[i : i + size]))
                if said in exact[h]:
                    r = int(row[i])
                    spans[r].append((i - int(first_word[r]), size, int(starts[i]), int(ends[i + size - 1])))
                    items[r] |= exact[h][said]
        all_spans, all_items = piece.column("spans").to_pylist(), piece.column("items").to_pylist()
        for r, hits in spans.items():
            # code points before a byte of this row: bytes that do not continue a character
            points = np.concatenate(([0], np.cumsum((data[at[r] : at[r + 1]] & 0xC0) != 0x80)))
            new = [(k, k + n, int(points[a - at[r]]), int(points[b - at[r]])) for k, n, a, b in hits]
            all_spans[r] = _merge(sorted([tuple(s[c] for c in SPAN) for s in all_spans[r]] + new))
            all_items[r] = sorted(items[r].union(all_items[r]))
        columns = {name: piece.column(name) for name in piece.schema.names} | {
            "spans": pa.array(all_spans, piece.schema.field("spans").type),
            "items": pa.array(all_items, piece.schema.field("items").type),
            "n_words": pa.array(np.bincount(row, minlength=piece.num_rows), pa.int64()),
        }
        yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)


def _merge(spans: list[tuple[int, ...]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for first, last, start, end in spans:
        if out and first <= out[-1][1]:
            out[-1][1], out[-1][3] = max(last, out[-1][1]), max(end, out[-1][3])
        else:
            out.append([first, last, start, end])
    return [dict(zip(SPAN, s)) for s in out]


def scan(
    documents: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES, with_text: bool = False,
) -> DataFrame:
    """One row per document: ``document`` (a struct of the carried columns), ``text`` if asked for,
    ``n_words``, ``spans`` (runs of hit words, ascending and disjoint, as word positions [first, last) and code
    points [start, end)) and ``items`` (those with occurring windows, as strings, ascending).

    A null or empty text has no words and no hits.  An item without an id or without words is no item; rows
    of one item id count as one item.  A short item is one window of its own length.  Repeated documents
    are scanned like any other; an empty benchmark hits nothing.  Columns that are not carried are not
    read, and carried names cannot clash with results, as they stay inside the struct.
    """
    spark = documents.sparkSession
    asked = benchmark.select(
        F.col(f"`{item_column}`").cast("string").alias("item"), F.col(f"`{item_text_column}`").cast("string").alias("text")
    ).where("item is not null and text is not null")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    span = ", ".join(f"`{c}`: int" for c in SPAN)
    rows = documents.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("document"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
        F.expr(f"cast(array() as array<struct<{span}>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
        F.lit(0).cast("long").alias("n_words"),
    )
    for block in range(blocks):
        # the rows of one block: about block_bytes, by the sum above
        here = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        windows = spark.sparkContext.broadcast(_window_set([(r["item"], r["text"]) for r in here], window))
        last = block + 1 == blocks
        names = [c for c in rows.columns if c != "text" or with_text or not last]

        def run(batches: Iterator[pa.RecordBatch], windows=windows, names=names) -> Iterator[pa.RecordBatch]:
            hasher = _Hasher()
            for batch in batches:
                yield from _scan(batch, windows.value, hasher, names)

        rows = rows.mapInArrow(run, rows.select(*names).schema)
        if not last:
            rows = stored(rows, "decontamination-block")
    return rows


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def without_spans(text: Column, spans: Column) -> Column:
    """The text without its hit runs."""
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    cut = F.aggregate(spans, start, lambda a, s: F.struct(
        F.concat(a["kept"], F.substring(text, a["at"] + 1, s["start"] - a["at"])).alias("kept"), s["end"].alias("at")
    ))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(cut["kept"], F.substring(text, cut["at"] + 1, F.char_length(text))))


def decontaminate(documents: DataFrame, benchmark: DataFrame, remove: str = "documents", text_column: str = "text", **options) -> DataFrame:
    """The documents, with their columns, after the removal of every document with a hit
    (``remove="documents"``) or of the hit runs inside them (``remove="spans"``)."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    others = tuple(c for c in documents.columns if c != text_column)
    rows = scan(documents, benchmark, others, text_column, with_text=True, **options)
    text = F.col("text")
    if remove == "documents":
        rows = rows.where(F.size("spans") == 0)
    else:
        text = without_spans(text, F.col("spans"))
    return rows.select(*[text.alias(c) if c == text_column else F.col(f"document.`{c}`").alias(c) for c in documents.columns])
