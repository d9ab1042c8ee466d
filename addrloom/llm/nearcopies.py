"""Near copies by SimHash: fingerprints find the candidates, full sets settle them.

Two documents are linked if their sets of distinct five-word shingles have a similarity of 0.8 or more.  Shingles are too
brittle to search by: one changed word changes five of them, and the fingerprints of half of such pairs are over 6 bits
apart.  So the fingerprints searched are those of the distinct *words*: at this similarity they are within 7 bits in 94 of 100
cases, and there are two by different hashes, so 4 in 1,000 such pairs are missed, fewer above 0.8.  Two more fingerprints, of the
shingles themselves, are compared for every pair that the trees find; they rule out nearly all that only share words, before
any text moves.  What is left is confirmed on the full sets.

Candidates are searched in Burkhard-Keller trees.  64 bits are cut into ``radius + extra`` blocks; of two fingerprints within the
radius ``extra`` blocks agree, so there is a table for every choice of that many blocks, and a tree for every value of the
chosen bits.  ``extra`` is 2, or more where trees would get too large: more tables of longer keys find the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrloom.llm.arrowtext import pieces
from addrloom.llm.components import components
from addrloom.llm.minhash import _mixed, _Powers, confirmed_links, shingle_sets
from addrloom.llm.shared import stored
from addrloom.llm.simhash import CHUNK, QUERY_SLICE, SEED, SHARD, Tree, _settle, one_of_each

SHINGLE = 5
PER_CENT = 80
RADIUS = 7
# of the 128 bits of two shingle fingerprints, sets with a similarity of 0.8 differ in 19 on average with a standard
# deviation of 4; unrelated ones in 64 with one of 6
FAR = 38
TREE = 1024
MOST_EXTRA = 4
PIECE_BYTES = 1 << 19
PAIRS = 1 << 18
CHUNK_SHINGLES, CHUNK_DOCUMENTS = 1 << 18, 1024
_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per set, of those that begin at ``starts``: bit k is 1 if it is set in over half of its hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    sizes = np.diff(np.append(starts, len(hashes)))
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<i8").reshape(-1)


def signed(documents: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """Per row: ``id``, ``n`` (size of its shingle set), ``c1`` and ``c2`` (which tell the set), ``t1`` and ``t2`` (which tell the
    text), ``f1`` and ``f2`` (fingerprints of its words), ``v1`` and ``v2`` (of its shingles).  Texts without words have zeros."""
    text = F.col(f"`{text_column}`").cast("string")
    texts = documents.select(
        F.col(f"`{id_column}`").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            for piece, data, at in pieces(batch, "text", PIECE_BYTES):
                hashes, bounds = shingle_sets(data, at, shingle, powers)
                words, word_bounds = shingle_sets(data, at, 1, powers)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                told = np.zeros((6, len(n)), np.int64)
                if len(full):
                    starts = bounds[full]
                    told[0, full] = np.add.reduceat(_mixed(hashes), starts).view(np.int64)
                    told[1, full] = np.add.reduceat(_mixed(hashes ^ _SALTS[0]), starts).view(np.int64)
                    told[2, full] = _majority(words, word_bounds[full])
                    told[3, full] = _majority(_mixed(words ^ _SALTS[0]), word_bounds[full])
                    told[4, full] = _majority(hashes, starts)
                    told[5, full] = _majority(_mixed(hashes ^ _SALTS[1]), starts)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), piece.column("t1"), piece.column("t2"), pa.array(n, pa.int64()), *map(pa.array, told)],
                    names=["id", "t1", "t2", "n", "c1", "c2", "f1", "f2", "v1", "v2"],
                )

    kind = documents.schema[id_column].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, t1 long, t2 long, n long, c1 long, c2 long, f1 long, f2 long, v1 long, v2 long")


# -- candidates --------------------------------------------------------------------------------

def masks(radius: int, extra: int) -> list[int]:
    """The chosen bits of every table, as signed numbers."""
    blocks = radius + extra
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [int(np.array(sum(c), np.uint64).view(np.int64)) for c in combinations(block, extra)]


def blocks_chosen(n: int, radius: int, tree: int) -> int:
    """The smallest number of chosen blocks, 2 at least, whose keys leave ``tree`` of ``n`` evenly spread values to a tree."""
    extra = 2
    while extra < MOST_EXTRA and n >> extra * (64 // (radius + extra)) > tree:
        extra += 1
    return extra


def _classes(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (key, value) in order, the rows in that order, and the bounds of every class in them."""
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (value[1:] != value[:-1])
    starts = np.flatnonzero(new)
    return key[starts], value[starts], order, np.append(starts, len(key))


def _spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .. ``count[0]`` of them, then those of the next."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def near_stars(key: np.ndarray, f: np.ndarray, v1: np.ndarray, v2: np.ndarray, tree: np.ndarray, ask: np.ndarray, radius: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (member, root) of a star for every group that near pairs of a ``tree`` row and an ``ask`` row of the same key join."""
    held, asked = np.flatnonzero(tree), np.flatnonzero(ask)
    t_key, t_value, t_order, t_at = _classes(key[held], f[held])
    q_key, q_value, q_order, q_at = _classes(key[asked], f[asked])
    label = np.arange(len(key))
    v1, v2 = v1.view(np.uint64), v2.view(np.uint64)  # the bits of a negative number are not those of its absolute value
    groups, t_group = np.unique(t_key, return_inverse=True)
    place = np.searchsorted(groups, q_key)
    known = np.flatnonzero(place < len(groups))
    known = known[groups[place[known]] == q_key[known]]
    forest = Tree(t_value.view(np.uint64), t_group)
    for i in range(0, len(known), QUERY_SLICE):
        some = known[i : i + QUERY_SLICE]
        for q, m in forest.near_parts(q_value[some].view(np.uint64), radius, place[some]):
            q = some[q]
            # a line for every asking row and class of held rows, then pairs of rows, a bounded number at a time
            n_rows = q_at[q + 1] - q_at[q]
            row, cls = asked[q_order[_spans(q_at[q], n_rows)]], np.repeat(m, n_rows)
            n_held = t_at[cls + 1] - t_at[cls]
            sofar = np.cumsum(n_held)
            cuts = np.searchsorted(sofar, np.arange(0, int(sofar[-1]) if len(sofar) else 0, PAIRS), side="right")
            for a, b in zip(cuts, np.append(cuts[1:], len(cls))):
                one = np.repeat(row[a:b], n_held[a:b])
                two = held[t_order[_spans(t_at[cls[a:b]], n_held[a:b])]]
                new = np.flatnonzero(label[one] != label[two])
                one, two = one[new], two[new]
                apart = np.bitwise_count(v1[one] ^ v1[two]).astype(np.int64) + np.bitwise_count(v2[one] ^ v2[two])
                label = _settle(label, one[apart <= far], two[apart <= far])
    joined = np.flatnonzero(label != np.arange(len(label)))
    return joined, label[joined]


def candidate_links(classes: DataFrame, radius: int = RADIUS, far: int = FAR, tree: int = TREE, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """Stars ``(u, v)`` that join the nodes whose ``f1`` or ``f2`` differ in at most ``radius`` bits and whose ``v1`` and ``v2`` in at most ``far``,
    from rows of ``node``, ``f1``, ``f2``, ``v1``, ``v2``.

    A task holds many trees, or where a value is common one pair of its chunks."""
    n = classes.count()
    shards = max(1, -(-n // shard))
    chosen = [(f, m) for f in ("f1", "f2") for m in masks(radius, blocks_chosen(n, radius, tree))]
    tables = F.array(*[
        F.struct(F.lit(i).alias("table"), F.col(f).alias("f"), F.col(f).bitwiseAND(F.lit(m)).alias("key")) for i, (f, m) in enumerate(chosen)
    ])
    members = classes.select("node", "v1", "v2", F.inline(tables))
    members = members.withColumn("shard", F.pmod(F.xxhash64("key", "table"), F.lit(shards)).cast("int"))
    # one number a shard of a table
    sizes = stored(members.groupBy("table", "shard").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")), "nearcopies-shards")
    cut = sizes.where("chunks > 1")
    members = members.join(cut, ["table", "shard"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    members = members.withColumn("own", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("own", o).alias("one"), F.greatest("own", o).alias("two")))
    members = members.select("table", "shard", "key", "node", "f", "v1", "v2", "own", F.inline(pairs))

    def run(rows: pa.Table) -> pa.Table:
        of = {c: rows.column(c).to_numpy() for c in ("key", "f", "v1", "v2", "node", "own")}
        one, two = rows.column("one")[0].as_py(), rows.column("two")[0].as_py()
        u, v = near_stars(of["key"], of["f"], of["v1"], of["v2"], of["own"] == one, of["own"] == two, radius, far)
        return pa.table({"u": of["node"][u], "v": of["node"][v]})

    return members.groupBy("table", "shard", "one", "two").applyInArrow(run, "u long, v long")


# -- documents ---------------------------------------------------------------------------------

def grouped(rows: DataFrame, documents: DataFrame, text_column: str, per_cent: int, shingle: int, radius: int, far: int, **sizes: int) -> DataFrame:
    """``c1``, ``c2`` and ``root`` of every set of ``rows`` (see ``signed``)."""
    sets = rows.groupBy("c1", "c2").agg(
        F.first("n").alias("n"), F.first("f1").alias("f1"), F.first("f2").alias("f2"), F.first("v1").alias("v1"), F.first("v2").alias("v2"), F.min(F.struct("t1", "t2")).alias("said"),
    )
    classes = stored(sets.withColumn("node", F.monotonically_increasing_id()), "nearcopies-classes")
    near = stored(candidate_links(classes.where("n > 0").select("node", "f1", "f2", "v1", "v2"), radius, far, **sizes).distinct(), "nearcopies-candidates")
    members = stored(classes.join(components(near), "node").select("root", "node", "n", "said.t1", "said.t2"), "nearcopies-members")
    links = confirmed_links(documents, text_column, members, shingle, per_cent, CHUNK_SHINGLES, CHUNK_DOCUMENTS)
    roots = components(stored(links, "nearcopies-links"))
    return classes.join(roots, "node", "left").select("c1", "c2", F.coalesce("root", "node").alias("root"))


def deduplicate(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", per_cent: int = PER_CENT, shingle: int = SHINGLE,
    radius: int = RADIUS, far: int = FAR, **sizes: int,
) -> DataFrame:
    """One document, with its columns, of every group that links join: the one with the smallest id, and of several texts of that
    id the one that hashes lowest.

    A link at exactly ``per_cent`` counts, and none below it does; a pair above it is missed where its words are more than
    ``radius`` bits apart in both fingerprints.  Texts that differ in case and white space alone are equal.  A text of fewer words than a shingle is one
    shingle.  Texts without words, null ones too, are copies of one another and linked with nothing else.  A group never
    goes as a whole, also where an id has texts in several groups.  Rows of one id and text are one document and stay once.
    A row without an id cannot be named by a group and stays.  Other columns may have any name.  An empty table gives no
    rows.  Components of links that do not settle in the rounds of ``components`` raise an error.
    """
    named = documents.where(F.col(f"`{id_column}`").isNotNull())
    rows = stored(signed(named, id_column, text_column, shingle), "nearcopies-signed")
    roots = stored(grouped(rows, named, text_column, per_cent, shingle, radius, far, **sizes), "nearcopies-roots")
    said = rows.groupBy("id", "t1", "t2").agg(F.first("c1").alias("c1"), F.first("c2").alias("c2"), F.count(F.lit(1)).alias("copies"))
    return one_of_each(documents, id_column, text_column, said.join(roots, ["c1", "c2"]))
