"""Encoding and decoding with a SentencePiece vocabulary, by Viterbi over batches of equally long words.

A text is a dummy space and its characters, a space being ``U+2581``.  No piece goes on beyond a word and no
piece of several characters holds a character that is in none, so a text falls into units with a best
segmentation each.  A task segments every different unit once.  Units of one length advance together: at each
position all substrings ending there are hashed by running sums, the hashes probe the sorted keys of the
pieces, and a maximum over the candidates gives score and backpointer.  A character without a piece becomes
its bytes.

The pieces' scores are those of the vocabulary where they are log probabilities.  A merge vocabulary has ranks
instead; there a piece of rank r gets the log probability of a Zipf law, so the result is the likeliest
segmentation under the vocabulary's ranking, not the replay of its merges.

The vocabulary file is read by the driver and its tables, of a size fixed by the vocabulary, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from addrloom.llm.arrowtext import pieces as text_pieces
from addrloom.llm.letters import powers

SPACE = 0x2581
LITERAL = 0x110000  # stands for a U+2581 of the text itself, which has no piece
UNKNOWN_PENALTY = 10.0
BITMAP_BITS = 20
BATCH_CELLS = 1 << 18
MEMORY = 1 << 19
_BASE = 0x9E3779B97F4A7C15


def _mix(codes: np.ndarray) -> np.ndarray:
    """An odd 64-bit value for every code point."""
    x = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def _running(codes: np.ndarray) -> np.ndarray:
    """Running sums over the last axis, one longer than it."""
    out = np.zeros((*codes.shape[:-1], codes.shape[-1] + 1), np.uint64)
    np.cumsum(_mix(codes) * powers(_BASE, codes.shape[-1]), axis=-1, out=out[..., 1:])
    return out


@dataclass(frozen=True)
class Vocabulary:
    """``pieces``: (text, log probability) by id for the pieces that match text, None for the others; ``byte_ids``:
    the id of every byte; ``said``: what an id decodes to, in bytes."""

    pieces: tuple[tuple[str, float] | None, ...]
    byte_ids: tuple[int, ...]
    said: tuple[bytes, ...]


def zipf(rank: float) -> float:
    return -float(np.log(rank + 2.0)) - 2.4


def load(path: str, merge_ranks: bool = True) -> Vocabulary:
    """A ``.model`` file.  ``merge_ranks``: its scores are minus the rank of a merge, not log probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found, byte_ids, said = [], [-1] * 256, []
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(text[3:5], 16)] = i
            said.append(bytes([int(text[3:5], 16)]))
            found.append(None)
        elif model.is_unknown(i) or model.is_control(i) or model.is_unused(i):
            said.append("�".encode() if model.is_unknown(i) else b"")
            found.append(None)
        else:
            score = model.get_score(i)
            said.append(text.replace(chr(SPACE), " ").encode())
            found.append((text, zipf(-score) if merge_ranks else score))
    if -1 in byte_ids:
        raise ValueError("the vocabulary has no piece for some byte")
    return Vocabulary(tuple(found), tuple(byte_ids), tuple(said))


def tables(vocabulary: Vocabulary) -> dict:
    """Arrays for the tasks: keys sorted, with ids and scores beside them."""
    by_length: dict[int, list[int]] = {}
    for i, p in enumerate(vocabulary.pieces):
        if p:
            by_length.setdefault(len(p[0]), []).append(i)
    keys, ids, joins = [], [], np.zeros(LITERAL + 1, bool)
    for length, members in by_length.items():
        codes = np.array([[ord(c) for c in vocabulary.pieces[i][0]] for i in members])
        keys.append(_running(codes)[:, -1])
        ids.append(members)
        if length > 1:
            joins[codes] = True
    keys, ids = np.concatenate(keys), np.concatenate(ids).astype(np.int32)
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    bitmap[keys >> np.uint64(64 - BITMAP_BITS)] = True
    scores = np.array([vocabulary.pieces[i][1] for i in ids])
    return {
        "keys": keys, "ids": ids, "scores": scores, "bitmap": bitmap, "joins": joins, "longest": max(by_length),
        "unknown": float(scores.min()) - UNKNOWN_PENALTY, "bytes": np.array(vocabulary.byte_ids, np.int32),
    }


def viterbi(t: dict, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentations of equally long units, as code points (units, length): per unit and end position the
    id of the best last piece (-1: a character without a piece) and its length.  Of equal scores the
    longest last piece wins."""
    n, length = codes.shape
    sums, back = _running(codes), powers(pow(_BASE, -1, 2**64), length + 1)
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0.0
    piece, size = np.full((n, length + 1), -1, np.int32), np.ones((n, length + 1), np.int32)
    rows, last = np.arange(n), len(t["keys"]) - 1
    for end in range(1, length + 1):
        low = max(0, end - t["longest"])
        hashes = (sums[:, end : end + 1] - sums[:, low:end]) * back[low:end]
        score, found = np.full(hashes.shape, -np.inf), np.full(hashes.shape, -1, np.int32)
        maybe = np.nonzero(t["bitmap"][hashes >> np.uint64(64 - BITMAP_BITS)])
        wanted = hashes[maybe]
        place = np.minimum(np.searchsorted(t["keys"], wanted), last)
        hit = t["keys"][place] == wanted
        at = (maybe[0][hit], maybe[1][hit])
        score[at], found[at] = t["scores"][place[hit]], t["ids"][place[hit]]
        single = score[:, -1]
        single[np.isneginf(single)] = t["unknown"]
        total = best[:, low:end] + score
        chosen = total.argmax(axis=1)
        best[:, end], piece[:, end], size[:, end] = total[rows, chosen], found[rows, chosen], end - low - chosen
    return piece, size


class Encoder:
    """Segments units, remembering the different ones."""

    def __init__(self, t: dict) -> None:
        self.t = t
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _segment(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after the other, and how many each has."""
        counts, made = np.zeros(len(starts), np.int64), []
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            length = int(sizes[order[a]])
            step = max(1, BATCH_CELLS // (length * self.t["longest"]))
            for i in range(a, b, step):
                at = order[i : min(i + step, b)]
                made.append(self._paths(at, codes[starts[at][:, None] + np.arange(length)]))
        owner, nth, ids = (np.concatenate([m[k] for m in made]) for k in range(3))
        order = np.lexsort((nth, owner))
        np.add.at(counts, owner, 1)
        return ids[order], counts

    def _paths(self, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, position, id) of the best pieces; backpointers followed for all units at once."""
        piece, size = viterbi(self.t, codes)
        owner, nth, ids = [], [], []
        live, end = np.arange(len(at)), np.full(len(at), codes.shape[1])
        while len(live):
            got, long = piece[live, end], size[live, end]
            known = got >= 0
            owner.append(at[live[known]])
            nth.append(4 * (end - long)[known])
            ids.append(got[known])
            for r, e in zip(live[~known].tolist(), end[~known].tolist()):
                code = int(codes[r, e - 1])
                said = (chr(SPACE) if code == LITERAL else chr(code)).encode("utf-8", "surrogatepass")
                owner.append(np.full(len(said), at[r]))
                nth.append(4 * (e - 1) + np.arange(len(said)))
                ids.append(self.t["bytes"][list(said)])
            end = end - long
            live, end = live[end > 0], end[end > 0]
        return np.concatenate(owner), np.concatenate(nth), np.concatenate(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of the texts in them."""
        lengths = np.array([len(x) + 1 if x else 0 for x in texts], np.int64)
        joined = "".join(" " + x for x in texts if x)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        codes = np.where(codes == SPACE, LITERAL, np.where(codes == 0x20, SPACE, codes))
        heads = np.cumsum(lengths) - lengths
        space, alone = codes == SPACE, ~self.t["joins"][codes]
        new = np.zeros(len(codes), bool)
        new[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        new[heads[lengths > 0]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(codes))
        sums = _running(codes)
        hashes = (sums[ends] - sums[starts]) * powers(pow(_BASE, -1, 2**64), len(codes) + 1)[starts]
        different, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, different)
        known = np.zeros(len(different), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == different
        if len(self.keys) + int((~known).sum()) > MEMORY and len(self.keys):
            self._forget()
            place, known = np.zeros(len(different), np.int64), np.zeros(len(different), bool)
        new = ~known
        if new.any():
            ids, counts = self._segment(codes, starts[first[new]], (ends - starts)[first[new]])
            self.begin = np.insert(self.begin, place[new], len(self.flat) + np.cumsum(counts) - counts)
            self.count = np.insert(self.count, place[new], counts)
            self.keys = np.insert(self.keys, place[new], different[new])
            self.flat = np.concatenate((self.flat, ids))
        at = np.searchsorted(self.keys, different)[which]
        counts = self.count[at]
        after = np.cumsum(counts)
        out = self.flat[np.repeat(self.begin[at] - (after - counts), counts) + np.arange(int(after[-1]))]
        # tokens before each text: those of all units that start before it
        before = np.concatenate(([0], after))
        return out, before[np.searchsorted(starts, np.append(heads, len(codes)))]


def decode_ids(said: list[bytes], ids: list[int | None]) -> str:
    """The text of ids: the dummy space is dropped; bytes that are no UTF-8, ids outside the vocabulary and null
    ids become ``U+FFFD``, control pieces nothing."""
    n = len(said)
    out = b"".join([said[i] if i is not None and 0 <= i < n else b"\xef\xbf\xbd" for i in ids])
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


# -- on Spark ----------------------------------------------------------------------------------

def encode(
    documents: DataFrame, vocabulary: Vocabulary, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text", check: bool = False,
) -> DataFrame:
    """``document`` (a struct of the carried columns) and ``ids``; with ``check`` also ``exact``, whether they decode
    to the text again.

    A null text has null ids (and a null check), an empty one none.  Every text decodes to itself, as characters
    without a piece are bytes and a ``U+2581`` of the text is too.  Whole texts, in memory linear in the longest.
    """
    rows = documents.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("document"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
    )
    results = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())][: 2 if check else 1]
    schema = T.StructType([rows.schema["document"], *results])
    shared = documents.sparkSession.sparkContext.broadcast((tables(vocabulary), list(vocabulary.said)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, said = shared.value
        encoder = Encoder(t)
        for batch in batches:
            for piece, _, _ in text_pieces(batch, "text"):
                texts = piece.column("text").to_pylist()
                ids, at = encoder.encode(texts)
                missing = np.array([x is None for x in texts])
                values = pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=np.append(missing, False)), pa.array(ids, pa.int32()))
                columns = [piece.column("document"), values]
                if check:
                    exact = [None if x is None else decode_ids(said, ids[a:b].tolist()) == x for x, a, b in zip(texts, at[:-1], at[1:])]
                    columns.append(pa.array(exact, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_column: str = "ids", text_column: str = "text") -> DataFrame:
    """The rows with ``text_column`` (replaced if there is one): the text of the ids, null of null ids."""
    said = encoded.sparkSession.sparkContext.broadcast(list(vocabulary.said))
    others = [c for c in encoded.columns if c != text_column]
    rows = encoded.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{ids_column}`").cast("array<int>").alias("ids"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(said.value, x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in others], F.col("text").alias(text_column))
