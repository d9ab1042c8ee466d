"""A tree of centres: many lists, each found by going down from a few centres.

With ``k`` flat centres every vector is compared with all of them.  In a tree a vector is compared
with the children of one node a level, so indexing costs about ``depth * k ** (1 / depth)``
comparisons a row, and fitting touches no node with more than ``BRANCHING`` children.  The lists are
the leaves.  A leaf that still holds many different vectors is split again, so a dense region gets
lists of ordinary size while the rest of the tree stays as it is.

The tree is held by the driver and by every task: at most ``MAX_TREE_NUMBERS`` numbers, which is
checked while it is fitted (262,144 nodes of 64 numbers, 16,384 of 1,024).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from addrloom.operators.distances import matrix, squared_distances
from addrloom.sources.tables import written

MAX_TREE_NUMBERS = 16 * 1024 * 1024
# Children of one node at most.
BRANCHING = 256
# Different vectors of the sample a list, and those one child is fitted on at most.
SAMPLE_PER_LIST = 64
FIT_PER_CHILD = 256
ROUNDS = 10
# A leaf with so many times its share of the sample is split again.
HOT = 2
MAX_DEPTH = 16
# A search keeps the nearest nodes of a level until they hold so many times the wanted lists.
WIDEN = 8


class CentreTree:
    """``centres`` and the ``parent`` of each (-1 at the top), level by level, children of a node
    side by side.  Its lists are its leaves, numbered in that order."""

    def __init__(self, centres: np.ndarray, parent: np.ndarray):
        self.centres = np.asarray(centres, dtype=np.float32)
        self.parent = np.asarray(parent, dtype=np.int64)
        if self.centres.size > MAX_TREE_NUMBERS:
            raise ValueError(f"{len(self.parent)} centres of {self.centres.shape[1]} numbers are too many to send to every task")
        nodes = np.arange(-1, len(self.parent))
        if (np.diff(self.parent) < 0).any() or (self.parent >= nodes[1:]).any():
            raise ValueError("children must follow their parents, side by side and in their order")
        # of node n at place n + 1, so that the root is -1
        self.first = np.searchsorted(self.parent, nodes, "left")
        self.last = np.searchsorted(self.parent, nodes, "right")
        self.leaf = (self.first == self.last)[1:]
        self.list_of = np.cumsum(self.leaf) - 1

    def __len__(self) -> int:
        return int(self.leaf.sum())

    def _children(self, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """Places in ``nodes`` of each different one, and the range of its children."""
        order = np.argsort(nodes, kind="stable")
        for places in np.split(order, np.flatnonzero(np.diff(nodes[order])) + 1):
            node = nodes[places[0]] + 1
            yield places, int(self.first[node]), int(self.last[node])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of every point and the squared distance to its centre, going down by the nearest child."""
        node = np.full(len(points), -1, dtype=np.int64)
        squared = np.zeros(len(points))
        open_ = np.arange(len(points))
        while len(open_):
            for places, first, last in self._children(node[open_]):
                rows = open_[places]
                distances = squared_distances(points[rows], self.centres[first:last].astype(np.float64))
                best = distances.argmin(axis=1)
                node[rows] = first + best
                squared[rows] = distances[np.arange(len(rows)), best]
            open_ = open_[~self.leaf[node[open_]]]
        return self.list_of[node], squared

    def _filled_below(self, filled: np.ndarray) -> np.ndarray:
        """Lists with rows at or below each node."""
        below = np.where(self.leaf, filled[self.list_of], False).astype(np.int64)
        for node in range(len(self.parent) - 1, -1, -1):
            if self.parent[node] >= 0:
                below[self.parent[node]] += below[node]
        return below

    def search(self, filled: np.ndarray, probes: int):
        """A function from points to (point, list): the ``probes`` nearest lists with rows among
        those below the nearest nodes of each level."""
        below = self._filled_below(filled)

        def probe(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            row = np.arange(len(points))
            node = np.full(len(points), -1, dtype=np.int64)
            gap = np.zeros(len(points))
            while True:
                inner = np.ones(len(node), dtype=bool)
                inner[node >= 0] = ~self.leaf[node[node >= 0]]
                if not inner.any():
                    break
                parts = [(row[~inner], node[~inner], gap[~inner])]
                rows_in = row[inner]
                for places, first, last in self._children(node[inner]):
                    children = first + np.flatnonzero(below[first:last])
                    rows = rows_in[places]
                    distances = squared_distances(points[rows], self.centres[children].astype(np.float64))
                    parts.append((np.repeat(rows, len(children)), np.tile(children, len(rows)), distances.ravel()))
                row, node, gap = (np.concatenate(c) for c in zip(*parts))
                row, node, gap = self._cut(row, node, gap, below[node], WIDEN * probes)
            row, node, _ = self._cut(row, node, gap, np.ones(len(node), dtype=np.int64), probes)
            return row, self.list_of[node]

        return probe

    @staticmethod
    def _cut(row, node, gap, weight, wanted):
        """Per row the nearest nodes, until the ones before weigh ``wanted`` or more."""
        order = np.lexsort((node, gap, row))
        row, node, gap, weight = row[order], node[order], gap[order], weight[order]
        before = np.cumsum(weight) - weight
        start = np.searchsorted(row, row, side="left")
        kept = before - before[start] < wanted if len(row) else np.zeros(0, dtype=bool)
        return row[kept], node[kept], gap[kept]

    def save(self, spark, path: str) -> None:
        rows = [(i, int(p), [float(x) for x in c]) for i, (p, c) in enumerate(zip(self.parent, self.centres))]
        spark.createDataFrame(rows, "node long, parent long, centre array<float>").coalesce(1).write.mode("overwrite").parquet(path)


def given_tree(tops: np.ndarray, below: np.ndarray) -> CentreTree:
    """Two levels from given centres: each of ``below`` under its nearest of ``tops``; a top without any goes."""
    under = squared_distances(below.astype(np.float64), tops.astype(np.float64)).argmin(axis=1)
    used, parent = np.unique(under, return_inverse=True)
    order = np.argsort(parent, kind="stable")
    return CentreTree(
        np.concatenate([tops[used], below[order]]), np.concatenate([np.full(len(used), -1), parent[order]])
    )


def most_nodes(dimension: int) -> int:
    return max(1, MAX_TREE_NUMBERS // max(dimension, 1))


def _k_means(points: np.ndarray, count: int, seed: int) -> np.ndarray:
    """At most ``count`` centres; one that loses all its points goes."""
    points = np.unique(points, axis=0)
    start = np.random.default_rng(seed).permutation(len(points))[:count]
    centres = points[np.sort(start)].astype(np.float64)
    for _ in range(ROUNDS):
        nearest = np.concatenate([
            squared_distances(points[at : at + 8192].astype(np.float64), centres).argmin(axis=1)
            for at in range(0, len(points), 8192)
        ])
        order = np.argsort(nearest, kind="stable")
        groups, first = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(points[order].astype(np.float64), first, axis=0)
        moved = sums / np.diff(np.append(first, len(points)))[:, None]
        if len(groups) == len(centres) and np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def _plan(sizes: dict[int, int], per_list: int, branching: int) -> dict[int, int]:
    """Children of the nodes that hold more than a list's share of the sample."""
    out = {}
    for node, size in sizes.items():
        lists = -(-size // per_list)
        if node < 0 or lists > HOT:
            levels = max(1, math.ceil(math.log(lists) / math.log(branching) - 1e-9))
            # two levels where one would compare with far more than the square root
            levels = max(levels, 2 if lists >= 64 else 1)
            out[node] = min(branching, max(2, math.ceil(lists ** (1.0 / levels))))
    return out


def fit_tree(
    vectors: DataFrame, lists: int | None = None, branching: int = BRANCHING, sample_per_list: int = SAMPLE_PER_LIST, seed: int = 42,
) -> CentreTree:
    """A tree with about ``lists`` lists (by default the square root of the rows, 100 at least).

    Fitted on the different vectors of a sample by hash of about ``lists * sample_per_list`` rows, so the
    sample follows the number of lists and a group of copies counts once; every row is indexed later.  Level by
    level the nodes that hold more than their share are split by k-means, each node in one task on at most
    ``branching * FIT_PER_CHILD`` vectors.  A node of equal vectors is not split.  Rows without a
    vector take no part; an empty table gives an error.
    """
    if not 2 <= branching <= BRANCHING:
        raise ValueError(f"a node has 2 to {BRANCHING} children")
    rows = vectors.where("vector IS NOT NULL").select(
        "source_id", F.col("vector").cast("array<float>").alias("vector")
    )
    first = rows.select(F.size("vector").alias("n")).first()
    if first is None:
        raise ValueError("no vectors to fit on")
    most = most_nodes(first["n"])
    count = rows.count()
    lists = min(most // 2, max(100, math.isqrt(count))) if lists is None else lists
    if lists > most // 2:
        raise ValueError(f"at most {most // 2} lists of this dimension")
    scale = 1_000_000_000
    spot = F.pmod(F.xxhash64(F.col("source_id").cast("string"), "vector"), F.lit(scale))
    share = min(1.0, lists * sample_per_list / max(count, 1))
    few = rows.where(spot < int(share * scale)) if share < 1.0 else rows
    if few.limit(1).count() == 0:
        few = rows.limit(1)
    # different vectors, each with a place of its own in the order in which nodes take them
    sample = written(
        few.groupBy("vector").agg(F.min(F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(scale))).alias("spot")), "tree-sample"
    )
    wanted = max(1, -(-sample.count() // max(lists, 1)))

    centres = np.zeros((0, first["n"]), dtype=np.float32)
    parent = np.zeros(0, dtype=np.int64)
    fixed: set[int] = set()  # split once, or of equal vectors
    for _ in range(MAX_DEPTH):
        placed = _placed(sample, centres, parent)
        sizes = {r["node"]: r["n"] for r in placed.groupBy("node").agg(F.count("*").alias("n")).collect()}  # a row a leaf
        plan = {n: c for n, c in _plan(sizes, wanted, branching).items() if n not in fixed}
        if not plan:
            break
        if len(parent) + sum(plan.values()) > most:
            raise ValueError(f"more than {most} centres of this dimension; ask for fewer lists")
        split = sample.sparkSession.createDataFrame(
            [(n, c, int(scale * min(1.0, FIT_PER_CHILD * c / sizes[n])) + 1) for n, c in plan.items()],
            "node long, children int, upto long",
        )
        taken = placed.join(F.broadcast(split), "node").where("spot < upto")  # at most a row a leaf
        found = taken.groupBy("node").applyInArrow(_split(seed), "node long, centre array<float>").collect()
        fixed |= set(plan)
        by_node: dict[int, list] = {}
        for r in found:
            by_node.setdefault(r["node"], []).append(r["centre"])
        grown = {n: c for n, c in by_node.items() if len(c) > 1 or n < 0}
        if not grown:
            break
        centres, parent, renamed = _grown(centres, parent, grown)
        fixed = {renamed[n] for n in fixed if n in renamed}
    return CentreTree(centres, parent)


def _placed(sample: DataFrame, centres: np.ndarray, parent: np.ndarray) -> DataFrame:
    """The sample with the ``node`` (a leaf so far) each vector is at."""
    if not len(parent):
        return sample.withColumn("node", F.lit(-1).cast("long"))
    tree = CentreTree(centres, parent)
    node_of = np.flatnonzero(tree.leaf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, _ = tree.nearest(matrix(batch.column("vector")).astype(np.float64))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(node_of[at], pa.int64())], names=[*batch.schema.names, "node"]
                )

    return sample.mapInArrow(run, T.StructType([*sample.schema, T.StructField("node", T.LongType())]))


def _split(seed: int):
    def run(table: pa.Table) -> pa.Table:
        node, children = table.column("node")[0].as_py(), table.column("children")[0].as_py()
        centres = _k_means(matrix(table.column("vector")), children, seed + node + 1).astype(np.float32)
        return pa.table({
            "node": pa.array([node] * len(centres), pa.int64()), "centre": pa.array(list(centres), pa.list_(pa.float32())),
        })

    return run


def _grown(centres: np.ndarray, parent: np.ndarray, grown: dict[int, list]):
    """The nodes with the new ones among them, level by level, and the new number of each old node."""
    old = len(parent)
    all_centres = np.concatenate([centres, *[np.array(c, dtype=np.float32) for c in grown.values()]])
    all_parents = np.concatenate([parent, *[np.full(len(c), n) for n, c in grown.items()]]).astype(np.int64)
    number = {-1: -1}
    order: list[int] = []
    below: dict[int, list[int]] = {}
    for i, p in enumerate(all_parents.tolist()):
        below.setdefault(p, []).append(i)
    level = below.get(-1, [])
    while level:
        for i in level:
            number[i] = len(order)
            order.append(i)
        level = [c for i in level for c in below.get(i, [])]
    renamed = {i: number[i] for i in [-1, *range(old)]}
    return all_centres[order], np.array([number[p] for p in all_parents[order].tolist()], dtype=np.int64), renamed
