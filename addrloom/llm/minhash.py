"""Near-duplicate documents by circulant MinHash.

A document is its set of distinct word shingles, hashed.  Two permutations of the 32-bit numbers give all
coordinates of a signature: the first spreads the elements, the second, shifted circularly by k, ranks them for
coordinate k, so ``h_k(S) = min over e in S of second(first(e) - k)``.  Bands of coordinates choose the buckets.

Documents that meet in a bucket, directly or by others, are one candidate group.  Its links are then settled exactly, on
the full sets: the texts of a group travel once to a task that compares bitmaps of the shared elements, and gives
a spanning star of what it links, never the pairs.  Equal sets are one from the start.  A group above ``CHUNK_SHINGLES``
or ``CHUNK_DOCUMENTS`` is cut into chunks, and every pair of its chunks is a task of its own; so texts that are alike but not
linked cost the square of their number in comparisons, though no task holds more than two chunks.

Bands are 48 of 8 coordinates: of two sets with a similarity of 0.85 no band agrees with a chance of 3e-7, at 0.9 of 2e-12;
sets below 0.4 rarely meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrloom.llm.arrowtext import pieces, word_bounds
from addrloom.llm.components import components
from addrloom.llm.keys import within
from addrloom.llm.shared import stored

SHINGLE = 5
BANDS, ROWS = 48, 8
PER_CENT = 85
CHUNK_SHINGLES, CHUNK_DOCUMENTS = 1 << 18, 1024
PIECE_BYTES = 1 << 19
# bytes of bitmaps that one comparison holds beside the bitmaps themselves
COMPARED_BYTES = 8 << 20

_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

_RANDOM = np.random.default_rng(11)
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RANDOM.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


# -- sets --------------------------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers without visible order."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n > len(self.up):
            def powers(base: int) -> np.ndarray:
                out = np.full(n, base % 2**64, np.uint64)
                out[:1] = 1
                return np.cumprod(out, dtype=np.uint64)

            self.up, self.down = powers(_BASE), powers(pow(_BASE, -1, 2**64))


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every row of a piece, ascending, row after row, and the ``rows + 1`` bounds."""
    starts, ends, row = word_bounds(_IS_WORD[data], at)
    powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[_SMALL[data]] * powers.up[: len(data)], out=sums[1:])
    word = _mixed((sums[ends] - sums[starts]) * powers.down[starts])
    counts = np.bincount(row, minlength=len(at) - 1)
    n = max(len(word) - size + 1, 0)
    whole = row[:n] == row[size - 1 :] if n else np.zeros(0, bool)
    hashes = np.full(n, size, np.uint64)
    for k in range(size):
        hashes += word[k : k + n] * _PLACES[k]
    hashes, of = hashes[whole], row[:n][whole]
    # texts of fewer words than a shingle
    short = np.flatnonzero((counts > 0) & (counts < size))
    first = np.cumsum(counts) - counts
    alone = counts[short].astype(np.uint64)
    for k in range(size - 1):
        there = counts[short] > k
        alone[there] += word[first[short[there]] + k] * _PLACES[k]
    hashes, of = _mixed(np.concatenate((hashes, alone))), np.concatenate((of, short))
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    return hashes, np.searchsorted(of, np.arange(len(at)))


# -- signatures --------------------------------------------------------------------------------

def _permute(x: np.ndarray, scratch: np.ndarray, a: int, b: int) -> None:
    """A permutation of the 32-bit numbers, in place."""
    for shift, factor in ((16, a), (13, b), (16, None)):
        np.right_shift(x, np.uint32(shift), out=scratch)
        np.bitwise_xor(x, scratch, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)


def signatures(hashes: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """``coordinates`` rows and a column for each of the sets that begin at ``starts``."""
    spread = (hashes >> np.uint64(32)).astype(np.uint32)
    rank, scratch = np.empty_like(spread), np.empty_like(spread)
    _permute(spread, scratch, 0x7FEB352D, 0x846CA68B)
    out = np.empty((coordinates, len(starts)), np.uint32)
    for k in range(coordinates):
        np.subtract(spread, np.uint32(k), out=rank)  # the circular shift
        _permute(rank, scratch, 0x85EBCA6B, 0xC2B2AE35)
        out[k] = np.minimum.reduceat(rank, starts)
    return out


def _buckets(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number per band and set that tells both the band and its coordinates."""
    parts = signature.reshape(bands, rows, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)[:, None] * np.uint64(_BASE)
    for r in range(rows):
        key = _mixed(key + parts[:, r] * _PLACES[r])
    return key


def signed_sets(documents: DataFrame, id_column: str, text_column: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """Per row: ``id``, ``n`` (size of its set), ``c1`` and ``c2`` (which tell the set), ``t1`` and ``t2`` (which tell the text),
    ``buckets`` (empty for an empty set)."""
    texts = documents.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    texts = texts.select("id", *_text_key(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            for piece, data, at in pieces(batch, "text", PIECE_BYTES):
                hashes, bounds = shingle_sets(data, at, shingle, powers)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                told, keys = np.zeros((2, len(n)), np.uint64), np.zeros((0, bands), np.uint64)
                if len(full):
                    starts = bounds[full]
                    told[0, full] = np.add.reduceat(_mixed(hashes), starts)
                    told[1, full] = np.add.reduceat(_mixed(hashes ^ _PLACES[0]), starts)
                    keys = _buckets(signatures(hashes, starts, bands * rows), bands, rows).T
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(keys).reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(n, pa.int64()), *map(pa.array, told.view(np.int64)), piece.column("t1"), piece.column("t2"), lists],
                    names=["id", "n", "c1", "c2", "t1", "t2", "buckets"],
                )

    kind = documents.schema[id_column].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, n long, c1 long, c2 long, t1 long, t2 long, buckets array<long>")


def _text_key():
    return F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2")


# -- exact links of a group ----------------------------------------------------------------------

def set_links(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, per_cent: int) -> np.ndarray:
    """Per set the number of a set that links reach from it, the same for all that are reached.  Links are those of a set
    marked ``first`` with one marked ``second`` whose intersection holds ``per_cent`` of their union."""
    n, label = len(sets), np.arange(len(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    of = np.repeat(np.arange(n), sizes)
    _, element, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # elements of one set alone are in no intersection
    number = np.cumsum(held > 1) - 1
    shared = held[element] > 1
    column, of = number[element[shared]], of[shared]
    width = int((held > 1).sum() + 63) // 64
    maps = np.zeros((n, max(width, 1)), np.uint64)
    np.bitwise_or.at(maps, (of, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    block = max(1, COMPARED_BYTES // (8 * maps.shape[1]))
    for i in np.flatnonzero(first).tolist():
        least, most = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        others = np.flatnonzero(second & (label != label[i]) & (100 * least >= per_cent * most))
        for b in range(0, len(others), block):
            some = others[b : b + block]
            both = np.bitwise_count(maps[some] & maps[i]).sum(axis=1, dtype=np.int64)
            for j in some[100 * both >= per_cent * (sizes[some] + sizes[i] - both)].tolist():
                label[label == label[j]] = label[i]
    return label


def _link_tasks(members: DataFrame, shingles: int, most_documents: int) -> DataFrame:
    """The members with the tasks that compare them: ``task``, ``one`` and ``two`` (the chunks it compares), ``own`` (its own chunk)."""
    size = members.groupBy("root").agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("documents"))
    chunks = F.ceil(F.greatest(F.col("held") / shingles, F.col("documents") / most_documents)).cast("int")
    size = stored(size.select("root", "held", chunks.alias("chunks")), "minhash-groups")
    small = size.where("chunks = 1").agg(F.sum("held")).first()[0] or 0
    shards = 1 + small // shingles
    rows = members.join(size, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # small groups share a task; a large one has a task for every pair of its chunks
    task = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("root"), F.lit(shards))).otherwise(-1 - F.col("root"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("own", o).alias("one"), F.greatest("own", o).alias("two")))
    return rows.select(task.alias("task"), "root", "node", "own", "t1", "t2", F.inline(pairs))


def confirmed_links(documents: DataFrame, text_column: str, members: DataFrame, shingle: int, per_cent: int, shingles: int, most_documents: int) -> DataFrame:
    """Stars ``(u, v)`` of the exact links within each group of ``members`` (root, node, n, t1, t2)."""
    texts = documents.select(F.col(f"`{text_column}`").cast("string").alias("text")).select(*_text_key(), "text")
    # only texts that some group wants leave their partition, and copies are one
    wanted = within(texts, members.select("t1", "t2"), "t1").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    rows = _link_tasks(members, shingles, most_documents).join(wanted, ["t1", "t2"]).drop("t1", "t2")

    def run(task: pa.Table) -> pa.Table:
        powers, sets = _Powers(), []
        batch = task.combine_chunks().to_batches()[0]
        for _, data, at in pieces(batch, "text", PIECE_BYTES):
            hashes, bounds = shingle_sets(data, at, shingle, powers)
            sets += [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        root, node, own, one, two = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("root", "node", "own", "one", "two"))
        u, v = [], []
        order = np.argsort(root, kind="stable")
        cuts = np.flatnonzero(np.diff(root[order])) + 1
        for rows_of in np.split(order, cuts):
            first, second = own[rows_of] == one[rows_of], own[rows_of] == two[rows_of]
            label = set_links([sets[i] for i in rows_of], first, second, per_cent)
            joined = np.flatnonzero(label != np.arange(len(label)))
            u.append(node[rows_of[joined]])
            v.append(node[rows_of[label[joined]]])
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})

    return rows.groupBy("task", "one", "two").applyInArrow(run, "u long, v long")


# -- documents -----------------------------------------------------------------------------------

def candidate_groups(classes: DataFrame) -> DataFrame:
    """``node`` and ``root`` of the nodes that share buckets with others, directly or by others."""
    keys = classes.select("node", F.explode("buckets").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    shared = stored(shared.select("bucket", "first"), "minhash-buckets")
    met = within(keys, shared.select("bucket"), "bucket").join(shared, "bucket").where("node > first")
    return components(met.select(F.col("node").alias("u"), F.col("first").alias("v")).distinct())


def near_duplicates(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", per_cent: int = PER_CENT, shingle: int = SHINGLE,
    bands: int = BANDS, rows: int = ROWS, chunk_shingles: int = CHUNK_SHINGLES, chunk_documents: int = CHUNK_DOCUMENTS,
) -> DataFrame:
    """One row per document: its id, ``n_shingles`` (the size of its set), ``component_id`` (the smallest id that links
    reach, its own included) and ``kept`` (its id is that one).

    A text of fewer words than a shingle is one shingle.  A null text, or one without words, has no shingle and
    is linked with nothing, not even with its like.  Repeated rows and equal sets are linked; each row keeps its row.  A null
    id is no smallest id; a group of null ids alone has a null component and keeps its rows.  Links at exactly ``per_cent``
    count.  An empty table gives no rows.  Only the two named columns are read.  Components of links that do not
    settle in the rounds of ``components`` raise an error.
    """
    found = stored(signed_sets(documents, id_column, text_column, shingle, bands, rows), "minhash-sets")
    full = found.where("n > 0").groupBy("c1", "c2").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.min(F.struct("t1", "t2")).alias("said"), F.first("buckets").alias("buckets"),
    )
    classes = stored(full.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    groups = candidate_groups(classes)
    members = stored(classes.join(groups, "node").select("root", "node", "n", "said.t1", "said.t2"), "minhash-members")
    stars = confirmed_links(documents, text_column, members, shingle, per_cent, chunk_shingles, chunk_documents)
    roots = components(stored(stars, "minhash-links"))
    rooted = stored(
        classes.join(roots, "node", "left").select("c1", "c2", "id", F.coalesce("root", "node").alias("root")), "minhash-roots",
    )
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component"))
    named = stored(rooted.join(smallest, "root").select("c1", "c2", "component"), "minhash-components")
    empty = F.col("n") == 0
    rows_of = found.where(~empty).join(named, ["c1", "c2"]).select("id", "n", "component")
    rows_of = rows_of.unionByName(found.where(empty).select("id", "n", F.col("id").alias("component")))
    return rows_of.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
