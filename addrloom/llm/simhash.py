"""Near-duplicate documents by 64-bit fingerprints and Burkhard-Keller trees.

Equal fingerprints are one before any search.  Two fingerprints that differ in at most ``radius`` bits
agree on at least one of ``radius + 1`` blocks of bits, so each fingerprint goes, once per block, to the
shard of its block's value.  A shard is a tree whose children are keyed by their distance to the parent;
a search follows only edges within the radius of the distance at hand.  Shards come to the searching tasks
by a shuffle: the fingerprints of all documents may not pass through the driver, as a driver-made
broadcast would have them do.

A shard above ``chunk`` members is cut: every pair of its chunks is a task of its own, so no task holds
more than two chunks.  A task returns a spanning star per group it found, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.llm.arrowtext import pieces, word_bounds
from addrloom.llm.components import components
from addrloom.llm.keys import with_bit
from addrloom.llm.shared import stored

SHINGLE = 3
SEED = 42
RADIUS = 3
SHARD = 4096
CHUNK = 16384
QUERY_SLICE = 1024
# nodes that a search looks at, and pairs that it gives, at one time
VISITED = 1 << 16

_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes; signed, 0 of no hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def _piece_fingerprints(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the rows of a piece."""
    is_word = _IS_WORD[data]
    starts, ends, row = word_bounds(is_word, at)
    # the words of the piece, one space between them: a shingle is then a plain slice
    lengths = ends - starts
    new_starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(starts) else starts
    flat = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    shift = np.repeat(new_starts - starts, lengths)
    source = np.flatnonzero(is_word)
    flat[source + shift] = _SMALL[data[source]]
    said = flat.tobytes()
    new_ends = new_starts + lengths
    bounds = np.searchsorted(row, np.arange(len(at)))
    out = np.zeros(len(at) - 1, np.int64)
    digest = xxhash.xxh64_intdigest
    for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b > a:
            k = min(size, b - a)
            cuts = zip(new_starts[a : b - k + 1].tolist(), new_ends[a + k - 1 : b].tolist())
            out[r] = fingerprint(np.array([digest(said[x:y], SEED) for x, y in cuts], np.uint64))
    return out


def fingerprints(documents: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``document`` (a struct of the carried columns) and ``fingerprint`` (long).

    A text of fewer words than a shingle is one shingle; a null text or one without words has fingerprint 0.
    """
    rows = documents.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("document"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, at in pieces(batch, "text"):
                found = pa.array(_piece_fingerprints(data, at, shingle), pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("document"), found], names=["document", "fingerprint"])

    schema = rows.select("document", F.lit(0).cast("long").alias("fingerprint")).schema
    return rows.mapInArrow(run, schema)


# -- one shard ---------------------------------------------------------------------------------

class Tree:
    """Burkhard-Keller trees over 64-bit values, as arrays: one tree, or one for every ``group`` (numbers 0, 1, ..), whose
    values are distinct.

    The root of group g is node g.  Nodes are numbered so that the children of a node are neighbours, ordered by their edge;
    ``first[n, e]`` is the first child of ``n`` with an edge of ``e`` or more."""

    def __init__(self, values: np.ndarray, group: np.ndarray | None = None) -> None:
        n = len(values)
        group = np.zeros(n, np.int64) if group is None else group
        self.values = np.zeros(n, np.uint64)
        self.member = np.zeros(n, np.int64)
        self.first = np.zeros((n, 66), np.int32)
        roots = np.unique(group, return_index=True)[1]
        made = len(roots)
        self.member[:made], self.values[:made] = roots, values[roots]
        below = np.ones(n, bool)
        below[roots] = False
        waiting = np.flatnonzero(below)
        parent = group[waiting]
        level = (0, made)
        while level[0] < level[1]:
            edge = np.bitwise_count(values[waiting] ^ self.values[parent]).astype(np.int64)
            key = parent * 65 + edge
            # of the members waiting at one edge the first becomes the child, the rest wait below it
            child_keys, chosen, place = np.unique(key, return_index=True, return_inverse=True)
            children = made + np.arange(len(child_keys))
            self.member[children] = waiting[chosen]
            self.values[children] = values[waiting[chosen]]
            nodes = np.arange(*level)
            self.first[nodes] = made + np.searchsorted(child_keys, nodes[:, None] * 65 + np.arange(66)[None, :])
            rest = np.ones(len(waiting), bool)
            rest[chosen] = False
            waiting, parent = waiting[rest], children[place][rest]
            level = (made, made + len(child_keys))
            made += len(child_keys)

    def near_parts(self, queries: np.ndarray, radius: int, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Query numbers and member numbers of all pairs within the radius, a bounded number at a time; a query searches the tree of its
        group.  Nodes wait as ranges of neighbours, of which ``VISITED`` are looked at together, so a tree of near values costs no more memory."""
        if not len(self.values) or not len(queries):
            return
        roots = np.zeros(len(queries), np.int64) if group is None else group
        waiting = [(np.arange(len(queries)), roots, np.ones(len(queries), np.int64))]
        found_q, found_m, n_found = [], [], 0
        while waiting:
            q, begin, count = waiting.pop()
            now = max(1, int(np.searchsorted(np.cumsum(count), VISITED, "right")))
            if now < len(q):
                waiting.append((q[now:], begin[now:], count[now:]))
                q, begin, count = q[:now], begin[:now], count[:now]
            node = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            q = np.repeat(q, count)
            distance = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            hit = distance <= radius
            found_q.append(q[hit])
            found_m.append(self.member[node[hit]])
            n_found += len(found_q[-1])
            if n_found >= VISITED:
                yield np.concatenate(found_q), np.concatenate(found_m)
                found_q, found_m, n_found = [], [], 0
            begin = self.first[node, np.maximum(distance - radius, 0)].astype(np.int64)
            count = self.first[node, np.minimum(distance + radius, 64) + 1] - begin
            more = count > 0
            if more.any():
                waiting.append((q[more], begin[more], count[more]))
        if n_found:
            yield np.concatenate(found_q), np.concatenate(found_m)

    def near(self, queries: np.ndarray, radius: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All of ``near_parts`` at once."""
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *self.near_parts(queries, radius, group)]
        return np.concatenate([q for q, _ in parts]), np.concatenate([m for _, m in parts])


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label over the groups that the pairs (a, b) join."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (jumped := new[new] != new).any():
            new[jumped] = new[new[jumped]]
        new = new[label]
        if (new == label).all():
            return label
        label = new


def shard_links(tree_values: np.ndarray, query_values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A star (member, root) per group that links within the radius join."""
    values = np.unique(np.concatenate((tree_values, query_values)))
    tree_at, query_at = np.searchsorted(values, tree_values), np.searchsorted(values, query_values)
    tree, label = Tree(tree_values), np.arange(len(values))
    for i in range(0, len(query_values), QUERY_SLICE):
        for q, m in tree.near_parts(query_values[i : i + QUERY_SLICE], radius):
            label = _settle(label, query_at[i + q], tree_at[m])
    joined = np.flatnonzero(label != np.arange(len(values)))
    return values[joined], values[label[joined]]


# -- all shards --------------------------------------------------------------------------------

def _blocks(value: Column, radius: int) -> list[Column]:
    width = 64 // (radius + 1)
    mask = (1 << width) - 1 if width < 64 else -1  # all bits of a signed number
    return [F.shiftrightunsigned(value, i * width).bitwiseAND(mask) for i in range(radius + 1)]


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """Links ``(u, v)`` that join exactly the groups of the fingerprints (column ``fingerprint``,
    distinct) with chains of steps of at most ``radius`` bits.  ``radius`` is at most 7."""
    if not 0 <= radius <= 7:
        raise ValueError("radius must be 0 to 7")
    value = F.col("fingerprint")
    n = distinct.count()
    # shards per block: about `shard` members each; blocks have no more values than this
    shards = 1 << min(64 // (radius + 1), max(0, math.ceil(math.log2(max(n, 1) / shard))))
    keys = F.array(*[
        F.struct(F.lit(i).alias("block"), F.pmod(F.xxhash64(b, F.lit(i)), F.lit(shards)).cast("int").alias("shard"))
        for i, b in enumerate(_blocks(value, radius))
    ])
    members = distinct.select("fingerprint", F.inline(keys))
    # one row per shard: at most (radius + 1) * shards
    sizes = members.groupBy("block", "shard").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fingerprint", F.lit(SEED)), F.col("chunks")).cast("int")
    members = members.join(F.broadcast(sizes), ["block", "shard"]).withColumn("own", own)
    # chunk c holds the tree in the tasks (c, c..) and asks in the tasks (..c, c)
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(
        F.least("own", o).alias("tree"), F.greatest("own", o).alias("ask")
    ))
    members = members.select("block", "shard", "fingerprint", "own", F.inline(pairs))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values, owner = rows["fingerprint"].to_numpy().view(np.uint64), rows["own"].to_numpy()
        u, v = shard_links(values[owner == key[2]], values[owner == key[3]], radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return members.groupBy("block", "shard", "tree", "ask").applyInPandas(run, "u long, v long")


def group(rows: DataFrame, radius: int = RADIUS, **sizes: int) -> DataFrame:
    """``fingerprint``, ``root`` (which tells its group) and ``component_id``, the smallest ``id`` over all rows that a chain of
    near fingerprints reaches; from rows of ``id`` and ``fingerprint``.  Null ids are no smallest id."""
    firsts = stored(rows.groupBy("fingerprint").agg(F.min("id").alias("id")), "simhash-distinct")
    found = components(links(firsts.select("fingerprint"), radius, **sizes))
    rooted = stored(
        firsts.join(found, firsts["fingerprint"] == found["node"], "left")
        .select("fingerprint", "id", F.coalesce("root", "fingerprint").alias("root")), "simhash-roots",
    )
    smallest = stored(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "simhash-smallest")
    return rooted.join(smallest, "root").select("fingerprint", "root", "component_id")


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, **sizes: int) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Null and empty texts have fingerprint zero and are linked like any other.  Repeated rows each give a
    row.  A null id keeps its row; a group of null ids only has a null component.  An empty table gives no
    rows.  Only the two named columns are read.  Chains of links that do not settle in the rounds of
    ``components`` raise an error.
    """
    rows = stored(
        fingerprints(documents, (id_column,), text_column)
        .select(F.col(f"document.`{id_column}`").alias("id"), "fingerprint"), "simhash-fingerprints",
    )
    found = group(rows, radius, **sizes)
    return rows.join(found, "fingerprint").select(
        F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id",
    )


def deduplicate(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document, with its columns, of every group: the one with the smallest id, and of several texts of that
    id the one that hashes lowest.

    So a group never goes as a whole, also where an id has texts in several groups.  Rows of one id and text are one document and
    stay once.  A row without an id cannot be named by a group and stays.  An empty table gives no rows.  Texts are shuffled
    only for documents that may go.
    """
    text = F.col(f"`{text_column}`").cast("string")
    key = [F.col(f"`{id_column}`").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]
    names = ("id", "t1", "t2")
    rows = stored(
        fingerprints(documents.select(*key, text.alias("text")).where("id is not null"), names).select("document.*", "fingerprint").drop("_"),
        "simhash-fingerprints",
    )
    found = group(rows, radius).select("fingerprint", "root")
    # a row per document
    said = rows.groupBy(*names).agg(F.first("fingerprint").alias("fingerprint"), F.count(F.lit(1)).alias("copies"))
    return one_of_each(documents, id_column, text_column, said.join(found, "fingerprint"))


def one_of_each(documents: DataFrame, id_column: str, text_column: str, said: DataFrame) -> DataFrame:
    """The smallest document of every ``root`` of ``said``, which has a row per id and text: ``id``, ``t1`` and ``t2`` (which tell
    the text), ``copies`` and ``root``.  Rows of a null id stay."""
    text = F.col(f"`{text_column}`").cast("string")
    key = [F.col(f"`{id_column}`").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]
    names = ("id", "t1", "t2")
    said = stored(said.select(*names, "copies", "root"), "simhash-documents")
    # stored, so that a large group's rows can be split in the join
    best = stored(said.groupBy("root").agg(F.min(F.struct(*names)).alias("best")), "simhash-best")
    judged = stored(said.join(best, "root").select(*names, "copies", (F.struct(*names) == F.col("best")).alias("stays")), "simhash-kept")
    gone = judged.where("not stays")
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), *key)
    named = whole.where("id is not null")
    marked = with_bit(named, judged.where("not stays or copies > 1"), "met", *names)
    settled = marked.where("met").drop("met").join(gone.select(*names), list(names), "left_anti").dropDuplicates(list(names))
    kept = marked.where("not met").select("row").unionByName(settled.select("row")).unionByName(whole.where("id is null").select("row"))
    return kept.select("row.*")
