"""Clustering around centroids, each vector's nearest found by the threshold algorithm.

The centroids are kept in one ascending list per dimension.  From a vector's own value each list is walked outward, the nearer
side first; a centroid seen anywhere is measured in full.  The frontiers' squared distances, summed over the dimensions, bound from
below what no list has shown yet, so the walk ends when that sum strictly exceeds the best distance: equal distances are all
seen, and the smaller number wins.

Vectors are fixed-point numbers and means are floors, so nothing depends on how the rows lie.  A round sends one sum per task,
centroid and dimension through a shuffle; the driver holds the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from addrloom.llm.shared import stored

DIMENSIONS, SCALE = 64, 64
CENTROIDS, ROUNDS, SEED = 16, 3, 1
SLICE = 2048


class SortedLists:
    """Centroids (rows of whole numbers) in a list per dimension."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        order = np.argsort(centroids, axis=0, kind="stable")
        self.number = order.T.copy()  # dimension, place
        self.value = np.take_along_axis(centroids, order, axis=0).T.copy()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row of ``x`` the centroid, its squared distance, and how many steps the lists were walked."""
        rows, dimensions = x.shape
        k = len(self.centroids)
        cluster, distance, steps = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        high = np.empty((rows, dimensions), np.int64)
        for d in range(dimensions):
            high[:, d] = np.searchsorted(self.value[d], x[:, d])
        low = high - 1
        seen = np.zeros((rows, k), bool)
        best, chosen, left = np.full(rows, np.iinfo(np.int64).max), np.full(rows, k), np.arange(rows)
        at = np.arange(dimensions)
        far = np.iinfo(np.int64).max
        for step in range(1, k + 1):
            below = np.where(low >= 0, x - self.value[at, np.maximum(low, 0)], far)
            above = np.where(high < k, self.value[at, np.minimum(high, k - 1)] - x, far)
            up = above < below
            place = np.where(up, high, low)
            frontier = np.where(up, above, below)
            low, high = low - ~up, high + up
            shown = np.zeros_like(seen)
            shown[np.repeat(np.arange(len(x)), dimensions), self.number[at, place].reshape(-1)] = True
            row, number = np.nonzero(shown & ~seen)
            seen |= shown
            off = x[row] - self.centroids[number]
            full = (off * off).sum(axis=1)
            # by row, distance and number, the first of each row
            order = np.lexsort((number, full, row))
            row, number, full = row[order], number[order], full[order]
            first = np.ones(len(row), bool)
            first[1:] = row[1:] != row[:-1]
            row, number, full = row[first], number[first], full[first]
            better = (full < best[row]) | ((full == best[row]) & (number < chosen[row]))
            best[row[better]], chosen[row[better]] = full[better], number[better]
            done = (frontier * frontier).sum(axis=1) > best
            if step == k:
                done[:] = True
            cluster[left[done]], distance[left[done]], steps[left[done]] = chosen[done], best[done], step
            go = ~done
            x, low, high, seen, best, chosen, left = x[go], low[go], high[go], seen[go], best[go], chosen[go], left[go]
            if not len(left):
                break
        return cluster, distance, steps


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fixed_point(embeddings: DataFrame, carry: tuple[str, ...], vector_column: str, dimensions: int) -> DataFrame:
    """``row`` (a struct of the carried columns) and ``x`` (array of long) of the rows whose vector is whole."""
    vector = F.col(f"`{vector_column}`").cast("array<double>")
    whole = (F.size(vector) == dimensions) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return embeddings.where(F.coalesce(whole, F.lit(False))).select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.transform(vector, lambda c: F.floor(c * SCALE).cast("long")).alias("x"),
    )


def _first_centroids(rows: DataFrame, id_column: str, centroids: int, seed: int) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"row.`{id_column}`").cast("string")).cast("binary"), 256)
    chosen = rows.select(key.alias("key"), "x").where("key is not null").orderBy("key", "x").limit(centroids).collect()
    return np.array([r["x"] for r in chosen], np.int64)


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``row``, ``cluster`` and ``distance`` (squared) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                cluster, distance, _ = lists.nearest(_matrix(part.column("x")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(cluster, pa.int32()), pa.array(distance)], names=["row", "cluster", "distance"]
                )

    return rows.mapInArrow(run, StructType([rows.schema["row"], *StructType.fromDDL("cluster int, distance long").fields]))


def means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of their vectors; those without any stay."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, sums, counts = SortedLists(centroids), np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                x = _matrix(batch.slice(i, SLICE).column("x"))
                cluster, _, _ = lists.nearest(x)
                np.add.at(sums, cluster, x)
                counts += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "held", "sums"],
        )

    parts = rows.select("x").mapInArrow(run, "cluster int, held long, sums array<long>")
    each = parts.select("cluster", "held", F.posexplode("sums").alias("at", "value"))
    total = each.groupBy("cluster", "at").agg(F.sum("held").alias("held"), F.sum("value").alias("value"))
    mean = F.expr("(value - pmod(value, held)) div held")
    new = centroids.copy()
    for r in total.select("cluster", "at", mean.alias("mean")).collect():  # a number per centroid and dimension
        new[r["cluster"], r["at"]] = r["mean"]
    return new


def cluster(
    embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", dimensions: int = DIMENSIONS, centroids: int = CENTROIDS,
    rounds: int = ROUNDS, seed: int = SEED, carry: tuple[str, ...] = (),
) -> DataFrame:
    """A row per vector: ``row`` (a struct of its id and the carried columns), ``cluster``, ``distance`` (squared), ``cluster_inertia``,
    ``inertia`` and ``centroid_sha256``.

    Rows whose vector is null, has another number of components than ``dimensions``, or holds a null or non-finite one are left out.  The
    first centroids are the vectors whose ids hash lowest; of repeated ids the smaller vector comes first, and a null id
    is never chosen.  With fewer vectors than ``centroids`` there are as many centroids as vectors with an id; without any, no rows.  Equal
    centroids share nothing: the smaller number takes all.  Equally near centroids: the smaller number.  Carried names cannot clash with
    results, as they stay inside the struct.  Components are meant to be below 2**24 in size, or sums of squares leave 64 bits.
    """
    rows = stored(fixed_point(embeddings, (id_column, *carry), vector_column, dimensions), "centroids-rows")
    found = _first_centroids(rows, id_column, centroids, seed)
    if not len(found):
        found = np.zeros((1, dimensions), np.int64)
        rows = rows.limit(0)
    for _ in range(rounds):
        found = means(rows, found)
    assigned = stored(assign(rows, found), "centroids-assigned")
    told = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(found.tolist())]
    names = embeddings.sparkSession.createDataFrame(told, "cluster int, centroid_sha256 string")
    # one row per centroid
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    known = sums.join(names, "cluster").join(F.broadcast(total))
    return assigned.join(F.broadcast(known), "cluster").select("row", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
