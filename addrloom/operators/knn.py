"""Nearest-neighbour joins of two vector tables.

Both joins share one shape.  Reference vectors belong to the *cell* of their
nearest centre; a query is sent to the cells it has to search; query and
reference rows meet in a co-group on the cell, which emits the best ``top_n``
of each query only; a window keeps the best ``top_n`` over all cells.

* :func:`knn_join` (exact) sends a query to the regions (neighbouring cells, as many as
  fit in a chunk) of every cell that can hold one of its ``top_n`` nearest vectors.  With the centre distances of a cell's members
  known, the triangle inequality bounds both the distance of the ``top_n``-th
  neighbour (from above) and that of a whole cell (from below); cells beyond
  the bound are skipped without changing the result.
* :func:`ivf_join` (approximate) sends a query to its ``probes`` nearest cells.

A cell may be hot on either side.  Both sides of a cell are therefore cut into
chunks (as many vectors as fit in
``CHUNK_BYTES``) by a hash of the id, and the unit
of work is (cell, query chunk, reference chunk): memory per task is bounded
whatever the skew.  What reaches the driver is one centre and a few numbers per
cell, with the number of cells limited by ``MAX_CELLS``.

A query is sent once for each reference chunk, so all that is sent grows with the product of both
sides.  The units are therefore done in rounds that send no more than both sides hold once, and what a
round has shuffled is dropped when its results, the best so far, are stored.  Only vectors, ids and hashes
of the other columns travel; names and addresses are joined to the result by these hashes.

Vector tables have the columns of ``schemas.QUERY_VECTORS`` and
``schemas.REFERENCE_VECTORS`` (``created_at`` is not needed).  Every row counts for
itself, also where a ``source_id`` occurs more than once.  Rows without a vector
take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from addrloom.functions.vectors import squared_l2
from addrloom.operators.centre_tree import CentreTree
from addrloom.operators.distances import Reduction, principal_axes
from addrloom.operators.distances import matrix as _matrix
from addrloom.operators.distances import rough_distances as _rough_distances
from addrloom.operators.distances import squared_distances as _squared_distances
from addrloom.sources.tables import discard, shuffles_dropped, work_folder, written
from addrloom.vocab import TOP_N

# Centres are held by the driver and by every task of the probing stage.
MAX_CELLS = 4000
MAX_CENTRE_NUMBERS = MAX_CELLS * 1024
# Slack for rounding when a bound decides what may be skipped.
SLACK = 1e-7
# Similarities that agree to so many digits are ties, settled by id.
TIE_DIGITS = 12
# Reference rows of a cell, where there are several.
CELL_ROWS = 8192
# Bytes of vectors in one chunk of one side, and numbers in one distance tile.
CHUNK_BYTES = 96 * 1024 * 1024
MIN_QUERY_CHUNK = 512
# Pairs of one group of the meeting: what bounds a task's time and its Python memory.  Both sides are cut alike, as a
# side is sent once for each chunk of the other.
GROUP_PAIRS = 1 << 30
GROUPS_PER_CORE = 8
TILE_NUMBERS = 2 * 1024 * 1024
# References of a tile, where the caller does not say.
BLOCK_ROWS = 4096
# Bytes that a round may send even if both sides hold less.
ROUND_BYTES = 256 * 1024 * 1024
# Pairs left for each of the wanted ones, beyond which a block looks for a closer bound of its own.
LOOSE = 4
# A first look at reduced vectors counts if no more than this share of the pairs remains: a pair by itself costs
# many times what it costs in a product of matrices.
REDUCED_SHARE = 1 / 16
REST_SLACK = 1e-5
AXES_SAMPLE = 2048

_QUERY_TEXTS = ("enterprise_id", "enterprise_name", "enterprise_address")
# two hashes of the other columns stand for them until the pairs are chosen
QUERY_HASHES = ("query_hash", "query_check")
REFERENCE_HASHES = ("reference_hash", "reference_check")
_QUERY_COLUMNS = ("query_row", *QUERY_HASHES)
_REFERENCE_COLUMNS = ("standard_id", "room_no", *REFERENCE_HASHES)
_STRINGS = ("standard_id", "room_no")


# ---------------------------------------------------------------------------
# parameters
# ---------------------------------------------------------------------------

def auto_lists(rows: int) -> int:
    """Number of cells for a table: rows / 1000 up to a million rows, the square
    root beyond, never below 100 or above 4000."""
    wanted = rows // 1000 if rows <= 1_000_000 else math.isqrt(rows)
    return max(100, min(MAX_CELLS, wanted))


def list_count(rows: Column) -> Column:
    """:func:`auto_lists` of a column of row counts."""
    wanted = F.when(rows <= 1_000_000, F.floor(rows / 1000)).otherwise(F.floor(F.sqrt(rows)))
    return F.greatest(F.lit(100), F.least(F.lit(MAX_CELLS), wanted)).cast("long")


def most_cells(dimension: int) -> int:
    """Cells whose centres the driver and every task can hold."""
    return max(1, min(MAX_CELLS, MAX_CENTRE_NUMBERS // max(dimension, 1)))


def auto_probes(lists: int) -> int:
    return max(1, math.isqrt(lists))


# ---------------------------------------------------------------------------
# shaping
# ---------------------------------------------------------------------------

def _hashes(names: tuple[str, ...], columns: tuple[str, ...]) -> list[Column]:
    """Two hashes of a row's contents; a null is told from a value."""
    contents = [c for name in columns for c in (F.col(name), F.col(name).isNull())]
    return [F.xxhash64(F.lit(i), *contents).alias(name) for i, name in enumerate(names)]


def _query_texts(queries: DataFrame) -> DataFrame:
    texts = queries.where("vector IS NOT NULL").select(
        F.col("source_id").cast("string").alias("enterprise_id"),
        F.col("enterprise_name").cast("string").alias("enterprise_name"),
        F.col("address").cast("string").alias("enterprise_address"),
        F.col("vector").cast("array<float>").alias("vector"),
    )
    return texts.select("*", *_hashes(QUERY_HASHES, _QUERY_TEXTS))


def _query_side(queries: DataFrame) -> DataFrame:
    # the number tells rows of one id apart
    return _query_texts(queries).select(F.monotonically_increasing_id().alias("query_row"), *QUERY_HASHES, "vector")


def _reference_texts(references: DataFrame, *extra: str) -> DataFrame:
    texts = references.where("vector IS NOT NULL").select(
        F.col("source_id").cast("string").alias("standard_id"),
        F.col("address").cast("string").alias("standard_address"),
        F.coalesce(F.col("room_no").cast("string"), F.lit("")).alias("room_no"),
        F.col("vector").cast("array<float>").alias("vector"),
        *extra,
    )
    return texts.select("*", *_hashes(REFERENCE_HASHES, ("standard_id", "room_no", "standard_address")))


def _reference_side(references: DataFrame, *extra: str) -> DataFrame:
    return _reference_texts(references, *extra).select(*_REFERENCE_COLUMNS, "vector", *extra)


@dataclass(frozen=True)
class Found:
    """The chosen ``pairs`` with hashes in place of names and addresses, and the two sides that hold these.  ``some_twice``: references
    of equal contents occur."""

    pairs: DataFrame
    queries: DataFrame
    references: DataFrame
    some_twice: bool

    def asked(self) -> DataFrame:
        """Id, name and address of the queries by their hashes, equal ones once."""
        return _query_texts(self.queries).groupBy(*QUERY_HASHES).agg(*[F.first(c).alias(c) for c in _QUERY_TEXTS])

    def told(self) -> DataFrame:
        """The address of the references by their hashes.  Equal ones are made one only if there are any, as a join
        right above its shuffles can be split where one reference is chosen often."""
        rows = _reference_texts(self.references).select(*REFERENCE_HASHES, "standard_address")
        return rows.groupBy(*REFERENCE_HASHES).agg(F.first("standard_address").alias("standard_address")) if self.some_twice else rows

    def with_texts(self, pairs: DataFrame | None = None) -> DataFrame:
        """``pairs`` (all) with names and addresses.  The longer texts, the references', join last."""
        return (self.pairs if pairs is None else pairs).join(self.asked(), list(QUERY_HASHES)).join(self.told(), list(REFERENCE_HASHES))

    def rows(self) -> DataFrame:
        return self.with_texts().select(*_QUERY_TEXTS, "standard_id", "standard_address", "room_no", "similarity")


def with_query_hashes(rows: DataFrame) -> DataFrame:
    """Rows with the columns of a query (id, name, address) and the hashes of these."""
    return rows.select("*", *_hashes(QUERY_HASHES, _QUERY_TEXTS))


def _some_twice(references: DataFrame) -> bool:
    counts = references.select(*REFERENCE_HASHES).groupBy(*REFERENCE_HASHES).count()
    return bool(counts.where("count > 1").take(1))


# ---------------------------------------------------------------------------
# cells
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Cells:
    """Centres, and per cell: rows, largest centre distance, and the smallest
    ``top_n`` centre distances (padded with infinity)."""

    centres: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    nearest: np.ndarray


def _check_centres(centres: np.ndarray | CentreTree) -> np.ndarray | CentreTree:
    """Flat centres of a bounded size; a tree checks its own."""
    if isinstance(centres, np.ndarray) and centres.size > MAX_CENTRE_NUMBERS:
        raise ValueError(f"{centres.shape[0]} centres of {centres.shape[1]} numbers are too many to send to every task")
    return centres


def assign_cells(references: DataFrame, centres: np.ndarray | CentreTree) -> DataFrame:
    """Add ``cell`` (nearest centre, in a tree the list reached going down) and ``centre_distance`` to rows with ``vector``."""
    _check_centres(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            points = _matrix(batch.column("vector")).astype(np.float64)
            if isinstance(centres, np.ndarray):
                squared = _squared_distances(points, centres)
                cell = squared.argmin(axis=1)
                squared = squared[np.arange(len(cell)), cell]
            else:
                cell, squared = centres.nearest(points)
            distance = np.sqrt(squared)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(distance)],
                names=[*batch.schema.names, "cell", "centre_distance"],
            )

    schema = T.StructType(
        list(references.schema)
        + [T.StructField("cell", T.IntegerType()), T.StructField("centre_distance", T.DoubleType())]
    )
    return references.mapInArrow(run, schema)


def _pick_centres(references: DataFrame, cells: int, reference_count: int) -> np.ndarray:
    """About ``cells`` reference vectors in hash order: a repeatable choice of
    pivots, taken from few more rows than are wanted.  Any choice gives the exact
    result."""
    spot = F.pmod(F.xxhash64("standard_id"), F.lit(1_000_000_000))
    share = min(1.0, 4.0 * cells / max(reference_count, 1))
    few = references.select("standard_id", "vector").where(spot < int(share * 1_000_000_000))
    picked = few.orderBy(spot, "standard_id").limit(cells).collect()
    rows = picked or references.select("vector").limit(1).collect()
    return np.array([row["vector"] for row in rows], dtype=np.float64)


def _describe_cells(assigned: DataFrame, centres: np.ndarray, top_n: int) -> Cells:
    """One pass: each batch gives rows, radius and smallest distances of its cells, and these
    are merged per cell."""
    schema = "cell int, n long, r double, nearest array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, distance = batch.column("cell").to_numpy(), batch.column("centre_distance").to_numpy()
            order = np.lexsort((distance, cell))
            cell, distance = cell[order], distance[order]
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            last = np.append(first[1:], len(cell))
            yield pa.RecordBatch.from_arrays([
                pa.array(cell[first], pa.int32()), pa.array(last - first, pa.int64()), pa.array(distance[last - 1] if len(cell) else distance),
                pa.array([distance[a : min(a + top_n, b)].tolist() for a, b in zip(first, last)], pa.list_(pa.float64())),
            ], names=["cell", "n", "r", "nearest"])

    count = len(centres)
    rows, radius = np.zeros(count, dtype=np.int64), np.zeros(count)
    nearest = np.full((count, top_n), np.inf)
    some = assigned.select("cell", "centre_distance").mapInArrow(run, schema)
    merged = some.groupBy("cell").agg(
        F.sum("n").alias("n"), F.max("r").alias("r"),
        F.slice(F.array_sort(F.flatten(F.collect_list("nearest"))), 1, top_n).alias("nearest"),
    )
    for row in merged.collect():  # a row per cell
        c, near = row["cell"], row["nearest"]
        rows[c], radius[c], nearest[c, : len(near)] = row["n"], row["r"], near
    return Cells(centres, rows, radius, nearest)


def _cells_to_search(points: np.ndarray, cells: Cells, top_n: int, reach: float) -> np.ndarray:
    """Rows x cells: which cells may hold one of a point's ``top_n`` nearest."""
    distance = np.sqrt(_squared_distances(points, cells.centres))
    near = min(8, distance.shape[1])
    closest = np.argpartition(distance, near - 1, axis=1)[:, :near]
    # distance to a member is at most the way over its centre
    upper = (np.take_along_axis(distance, closest, axis=1)[:, :, None] + cells.nearest[closest]).reshape(len(points), -1)
    bound = np.partition(upper, top_n - 1, axis=1)[:, top_n - 1]
    bound = np.minimum(bound, reach)
    lower = distance - cells.radius[None, :]
    return (lower <= bound[:, None] + SLACK) & (cells.rows > 0)[None, :]


def _regions(centres: np.ndarray | CentreTree, rows: np.ndarray, most_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells in an order that keeps near ones together (along the direction in which the centres
    spread most; the lists of a tree in their own), and the first place of each region: neighbours of ``most_rows`` rows at most, or
    one larger cell.  A query is sent once to a region, whichever of its cells it searches."""
    order = np.arange(len(rows))
    if isinstance(centres, np.ndarray):
        spread = centres - centres.mean(axis=0)
        axis = np.linalg.svd(spread, full_matrices=False)[2][0]
        order = np.argsort(spread @ axis, kind="stable")
    first, filled = [0], 0
    for place, n in enumerate(rows[order].tolist()):
        if filled and filled + n > most_rows:
            first.append(place)
            filled = 0
        filled += n
    return order, np.array(first)


def _region_of(order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The region of each cell."""
    region = np.empty(len(order), dtype=np.int64)
    region[order] = np.searchsorted(first, np.arange(len(order)), side="right") - 1
    return region


def _cells_to_probe(points: np.ndarray, centres: np.ndarray, filled: np.ndarray, probes: int) -> np.ndarray:
    """Rows x cells: the ``probes`` nearest cells that have members."""
    squared = _squared_distances(points, centres)
    squared[:, ~filled] = np.inf
    order = np.argsort(squared, axis=1, kind="stable")[:, : min(probes, int(filled.sum()))]
    chosen = np.zeros(squared.shape, dtype=bool)
    np.put_along_axis(chosen, order, True, axis=1)
    return chosen


def _by_region(row: np.ndarray, cell: np.ndarray, region: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(point, region, lists to search there) of (point, list); null: all ``filled`` ones of the region."""
    order = np.lexsort((cell, region[cell], row))
    row, cell = row[order], cell[order]
    where = region[cell]
    start = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(where) != 0))[: len(row)])
    size = np.diff(np.append(start, len(row)))
    whole = size == filled[where[start]]
    offsets = np.append(0, np.cumsum(np.where(whole, 0, size)))
    lists = pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32(), mask=np.append(whole, False)), pa.array(cell[np.repeat(~whole, size)], pa.int32())
    )
    return row[start], where[start], lists


def _aimed(queries: DataFrame, choose) -> DataFrame:
    """The queries, stored, with the cells or regions they search (``targets``); ``choose`` gives (point, cell, lists of it),
    ordered by point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                row, cell, lists = choose(_matrix(part.column("vector")).astype(np.float64))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                aims = pa.StructArray.from_arrays([pa.array(cell, pa.int32()), lists], names=["cell", "lists"])
                targets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), aims)
                yield pa.RecordBatch.from_arrays([*part.columns, targets], names=[*part.schema.names, "targets"])

    aim = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("lists", T.ArrayType(T.IntegerType()))])
    return queries.mapInArrow(run, T.StructType([*queries.schema, T.StructField("targets", T.ArrayType(aim))]))


def _send_to_cells(aimed: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """One row per query and cell it searches (column ``cell``), of all cells or the numbers from ``first`` to ``last``."""
    targets = F.col("targets")
    if first is not None:
        targets = F.filter(targets, lambda t: t["cell"].between(first, last))
    rows = aimed.select(*_QUERY_COLUMNS, "vector", F.explode(targets).alias("_t"))
    return rows.select(*_QUERY_COLUMNS, "vector", "_t.cell", "_t.lists")


# ---------------------------------------------------------------------------
# meeting of the two sides
# ---------------------------------------------------------------------------

def _first_copies(vectors: np.ndarray, by_id: np.ndarray, top_n: int) -> np.ndarray:
    """Rows worth comparing: of equal vectors only the ``top_n`` smallest ids can
    be in a result."""
    packed = np.ascontiguousarray(vectors[by_id])
    rows = packed.view(np.dtype((np.void, packed.dtype.itemsize * packed.shape[1]))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    if np.bincount(group).max() <= top_n:
        return np.sort(by_id)
    by_group = np.argsort(group, kind="stable")
    place = np.arange(len(group))
    first = np.concatenate([[True], np.diff(group[by_group]) != 0])
    place = place - np.maximum.accumulate(np.where(first, place, 0))
    return np.sort(by_id[by_group[place < top_n]])


def _exact(tile: np.ndarray, vectors: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Squared distances of the given pairs in double precision, difference by difference."""
    exact = np.empty(len(row))
    for at in range(0, len(row), 4096):
        gap = tile[row[at : at + 4096]].astype(np.float64) - vectors[column[at : at + 4096]]
        exact[at : at + 4096] = (gap * gap).sum(axis=1)
    return exact


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the few true entries, eight at a time."""
    if mask.size % 8 or not mask.flags.c_contiguous:
        return np.nonzero(mask)
    flat = mask.reshape(-1)
    words = np.flatnonzero(flat.view(np.uint64))
    word, byte = np.nonzero(flat.reshape(-1, 8)[words])
    return np.divmod(words[word] * 8 + byte, mask.shape[1])


def _may_be_best(
    tile: np.ndarray, vectors: np.ndarray, top_n: int, limit: float | np.ndarray, slack: float,
    reduced: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column) of the pairs that can be among the ``top_n`` of their row and within ``limit`` (one, or one a row), and how many
    numbers were multiplied to tell.

    With ``reduced`` forms of both sides their distances, which are lower bounds, are found first: the exact
    distances to the ``top_n`` that look nearest bound the ``top_n``-th neighbour, and only pairs below that remain.  If
    more than a REDUCED_SHARE of them remain, all distances are computed as without.  A limit that leaves LOOSE times the wanted
    pairs or fewer is close enough, and no other is looked for."""
    rows, many = len(tile), len(vectors)
    bound = np.broadcast_to(np.asarray(limit, dtype=np.float64), (rows,))
    below = lambda distances: distances <= (bound + slack).astype(np.float32)[:, None]
    loose = lambda mask: many > top_n and np.count_nonzero(mask) > LOOSE * top_n * rows
    multiplied = 0
    if reduced is not None and many > top_n:
        low = _rough_distances(*reduced)
        multiplied = rows * many * reduced[0].shape[1]
        mask = below(low)
        if loose(mask):
            seem = np.argpartition(low, top_n - 1, axis=1)[:, :top_n]
            near = _exact(tile, vectors, np.repeat(np.arange(rows), top_n), seem.ravel()).reshape(rows, top_n)
            multiplied += rows * top_n * tile.shape[1]
            bound = np.minimum(bound, near.max(axis=1))
            mask = below(low)
        if np.count_nonzero(mask) <= REDUCED_SHARE * rows * many:
            return *_places(mask), multiplied
    squared = _rough_distances(tile, vectors)
    mask = below(squared)
    if loose(mask):
        bound = np.minimum(bound, np.partition(squared, top_n - 1, axis=1)[:, top_n - 1])
        mask = below(squared)
    return *_places(mask), multiplied + rows * many * tile.shape[1]


def _longest(vectors: np.ndarray) -> float:
    """The largest squared length of a row, without a second copy of all rows."""
    return max(float((vectors[at : at + 4096].astype(np.float64) ** 2).sum(axis=1).max()) for at in range(0, len(vectors), 4096))


def _blocks(searched: pa.Array, spans: dict[int, tuple[int, int]] | None, count: int, step: int):
    """(places of the queries in a tile or None for all, first and last reference) of what is compared at once."""
    if spans is None:
        yield from ((None, at, min(at + step, count)) for at in range(0, count, step))
        return
    whole = np.flatnonzero(searched.is_null().to_numpy(zero_copy_only=False))
    asker = np.repeat(np.arange(len(searched)), searched.value_lengths().fill_null(0).to_numpy())
    wanted = searched.flatten().to_numpy()
    for n, (first, last) in spans.items():
        asks = np.sort(np.concatenate([whole, asker[wanted == n]]))
        if len(asks):
            yield from ((asks, at, min(at + step, last)) for at in range(first, last, step))


def _closer(nearest: np.ndarray, bound: np.ndarray, row: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """The bounds after these pairs; ``nearest`` holds the smallest distances of each row so far and is brought up to date."""
    top_n = nearest.shape[1]
    order = np.lexsort((exact, row))
    row, exact = row[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    few = place < top_n
    fresh = np.full(nearest.shape, np.inf)
    fresh[row[few], place[few]] = exact[few]
    nearest[:] = np.partition(np.concatenate([nearest, fresh], axis=1), top_n - 1, axis=1)[:, :top_n]
    return np.minimum(bound, nearest.max(axis=1))


def _best_of_chunk(top_n: int, threshold: float | None, reduction: Reduction | None = None, tile_rows: int | None = None):
    """Co-group function: the ``top_n`` best references of each query here, ``tile_rows`` (None: all) references at a time.

    Distances are first computed in single precision, to find the rows that can
    be among the best within the rounding bound of that product; these are then
    computed again in double precision, difference by difference.
    """
    limit = math.inf if threshold is None else 2.0 * (1.0 - threshold)
    columns = [*_QUERY_COLUMNS, *_REFERENCE_COLUMNS]

    def best(queries: pa.Table, references: pa.Table) -> Iterator[pa.Table]:
        vectors = _matrix(references.column("vector"))
        ids = references.column("standard_id").to_pylist()
        by_id = np.array(sorted(range(len(ids)), key=ids.__getitem__), dtype=np.int64)
        id_place = np.empty_like(by_id)
        id_place[by_id] = np.arange(len(by_id))
        searched, lists = queries.column("lists").combine_chunks(), references.column("list").to_numpy()
        if searched.null_count == len(searched):
            kept, spans = _first_copies(vectors, by_id, top_n), None
        else:
            # some queries search a part of the lists here: those of a list side by side
            names = np.unique(lists)
            parts = [_first_copies(vectors, by_id[lists[by_id] == n], top_n) for n in names]
            kept, ends = np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts]).tolist()
            spans = {int(n): span for n, span in zip(names, zip(ends, ends[1:]))}
        vectors = vectors[kept]
        points = _matrix(queries.column("vector"))
        reach = max(_longest(points), _longest(vectors))
        slack = SLACK + 8.0 * vectors.shape[1] * float(np.finfo(np.float32).eps) * max(reach, 1.0)
        few = None
        if reduction is not None:
            few = reduction(points), reduction(vectors)
            # the mean moves the vectors, and the length of the rest is rounded by its own
            slack += (8.0 * vectors.shape[1] * float(np.finfo(np.float32).eps) + REST_SLACK) * max(map(_longest, few))
        step = min(tile_rows or BLOCK_ROWS, len(vectors))
        rows_at_once = max(16, TILE_NUMBERS // step)
        for start in range(0, len(points), rows_at_once):
            tile = points[start : start + rows_at_once]
            nearest = np.full((len(tile), top_n), np.inf)
            bound = np.full(len(tile), limit)
            found = []
            for asks, first, last in _blocks(searched.slice(start, rows_at_once), spans, len(vectors), step):
                part = tile if asks is None else tile[asks]
                reduced = None
                if few is not None:
                    reduced = few[0][start : start + rows_at_once], few[1][first:last]
                    reduced = reduced if asks is None else (reduced[0][asks], reduced[1])
                row, column, _ = _may_be_best(part, vectors[first:last], top_n, bound if asks is None else bound[asks], slack, reduced)
                if not len(row):
                    continue
                row, column = row if asks is None else asks[row], column + first
                exact = _exact(tile, vectors, row, column)
                close = exact <= bound[row] + SLACK
                found.append((row[close], column[close], exact[close]))
                bound = _closer(nearest, bound, *found[-1][::2])
            if not found:
                continue
            row, column, exact = (np.concatenate(c) for c in zip(*found))
            close = exact <= bound[row] + SLACK
            row, column, similarity = row[close], column[close], 1.0 - exact[close] / 2.0
            if threshold is not None:
                passed = similarity >= threshold
                row, column, similarity = row[passed], column[passed], similarity[passed]
            order = np.lexsort((id_place[kept[column]], -np.round(similarity, TIE_DIGITS), row))
            row, column, similarity = row[order], column[order], similarity[order]
            first = np.arange(len(row)) - np.searchsorted(row, row, side="left") < top_n
            row, column, similarity = row[first], column[first], similarity[first]
            q = queries.select(_QUERY_COLUMNS).take(pa.array(row + start))
            r = references.select(_REFERENCE_COLUMNS).take(pa.array(kept[column]))
            yield pa.table([*q.columns, *r.columns, pa.array(similarity)], names=[*columns, "similarity"])

    def run(queries: pa.Table, references: pa.Table) -> pa.Table:
        out = list(best(queries, references)) if queries.num_rows and references.num_rows else []
        if out:
            return pa.concat_tables(out)
        kinds = [*[pa.string() if c in _STRINGS else pa.int64() for c in columns], pa.float64()]
        return pa.table([pa.array([], k) for k in kinds], names=[*columns, "similarity"])

    return run


_PAIR_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType() if n in _STRINGS else T.LongType()) for n in (*_QUERY_COLUMNS, *_REFERENCE_COLUMNS)]
    + [T.StructField("similarity", T.DoubleType())]
)


def keep_top_n(candidates: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` most similar candidates of each query, ties by id.  Spark
    cuts every input partition to ``top_n`` per query before the shuffle."""
    closeness = F.round("similarity", TIE_DIGITS)
    order = Window.partitionBy("query_row").orderBy(closeness.desc(), F.asc("standard_id"))
    return candidates.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top_n).drop("_rank")


@dataclass(frozen=True)
class Part:
    """Reference chunks ``first`` to ``last`` (exclusive) of a cell with all its query chunks, numbered from ``place``."""

    cell: int
    q_chunks: int
    r_chunks: int
    first: int
    last: int
    place: int

    @property
    def places(self) -> int:
        return self.q_chunks * (self.last - self.first)


def _rounds(
    chunks: dict[int, tuple[int, int]], reference_rows: dict[int, int], query_rows: dict[int, int], most_rows: int,
) -> list[list[Part]]:
    """The work in order of the cells, cut where a round would send more than ``most_rows`` rows."""
    rounds: list[list[Part]] = [[]]
    sent = place = 0
    for cell, (q, r) in sorted(chunks.items()):
        each = query_rows[cell] + -(-reference_rows[cell] // r) * q
        first = 0
        while first < r:
            taken = min(r - first, max((most_rows - sent) // each, 0 if sent else 1))
            if taken:
                rounds[-1].append(Part(cell, q, r, first, first + taken, place))
                first, sent, place = first + taken, sent + each * taken, place + q * taken
            else:
                rounds.append([])
                sent = place = 0
    return rounds


def _chunked(df: DataFrame, parts: DataFrame | None, row_column: str, mine: str) -> DataFrame:
    """Rows of one side, once for every ``place`` they are needed at."""
    if parts is None:
        return df.withColumn("place", F.lit(0))
    df = df.join(F.broadcast(parts), "cell")  # a row a cell
    chunk = F.pmod(F.xxhash64(row_column), F.col(f"{mine}_chunks"))
    if mine == "q":
        at = F.explode(F.sequence(F.lit(0), F.col("last") - F.col("first") - 1))
        df = df.withColumn("_mine", chunk).withColumn("_other", at)
        place = F.col("_other") * F.col("q_chunks") + F.col("_mine")
    else:
        df = df.withColumn("_mine", chunk).where("_mine >= first AND _mine < last")
        df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("q_chunks") - 1)))
        place = (F.col("_mine") - F.col("first")) * F.col("q_chunks") + F.col("_other")
    place = (F.col("place") + place).cast("int")
    return df.withColumn("place", place).drop("_mine", "_other", "q_chunks", "r_chunks", "first", "last")


def _meet(
    sent: DataFrame, assigned: DataFrame, reference_rows: dict[int, int], query_rows: dict[int, int],
    top_n: int, threshold: float | None, chunk_rows: int, reduction: Reduction | None = None, tile_rows: int | None = None,
    aimed: DataFrame | None = None, spent: tuple[str, ...] = (),
) -> DataFrame:
    """The best ``top_n`` pairs of every query.  More than one round of them is done here and now; that needs
    the stored queries ``aimed``, as the numbers of their rows must not change, and ends the use of the folders ``spent``."""
    spark = assigned.sparkSession
    dimension = _dimension(assigned)
    # enough query chunks to keep all cores busy, each worth a task of its own
    cores = spark.sparkContext.defaultParallelism
    reference_rows = {c: n for c, n in reference_rows.items() if n and query_rows.get(c)}
    query_chunk = min(chunk_rows, max(MIN_QUERY_CHUNK, -(-sum(query_rows.values()) // (2 * cores))))
    chunks = {}
    for cell, n in reference_rows.items():
        q = -(-query_rows[cell] // query_chunk)
        level = -(-q // cores) * cores  # no core waits for the last chunks
        chunks[cell] = (level if level <= 2 * q and query_rows[cell] >= level * MIN_QUERY_CHUNK else q, -(-n // chunk_rows) or 1)
    row_bytes = 4 * dimension + 32
    linear = sum(reference_rows.values()) + max(query_rows.values(), default=0)
    most = max(ROUND_BYTES // row_bytes, linear)
    rounds = [[]] if not chunks else _rounds(chunks, reference_rows, query_rows, most if aimed is not None else 1 << 62)

    def one(parts: list[Part]) -> DataFrame:
        sizes, left = None, sent
        count = sum(p.places for p in parts)
        if count != 1 or len(rounds) > 1:
            sizes = spark.createDataFrame(
                [(p.cell, p.q_chunks, p.r_chunks, p.first, p.last, p.place) for p in parts],
                "cell int, q_chunks int, r_chunks int, first int, last int, place int",
            )
        if len(rounds) > 1:
            left = _send_to_cells(aimed, parts[0].cell, parts[-1].cell)
        # a group is much arithmetic on few bytes: a few per core, and more where the vectors
        # that meet need it, whatever number of cores is visible at the start
        rows = sum(p.places * (-(-query_rows[p.cell] // p.q_chunks) + -(-reference_rows[p.cell] // p.r_chunks)) for p in parts)
        pairs = sum(query_rows[p.cell] * reference_rows[p.cell] * (p.last - p.first) // p.r_chunks for p in parts)
        wanted = max(GROUPS_PER_CORE * cores, -(-rows * row_bytes // CHUNK_BYTES), -(-2 * pairs // GROUP_PAIRS))
        groups = max(1, min(wanted, count))
        left = _chunked(left, sizes, "query_row", "q").select(*_QUERY_COLUMNS, "vector", "lists", "place")
        right = _chunked(assigned, sizes, "standard_id", "r").select(*_REFERENCE_COLUMNS, "vector", "list", "place")
        return (
            left.repartitionById(groups, F.col("place")).groupBy("place")
            .cogroup(right.repartitionById(groups, F.col("place")).groupBy("place"))
            .applyInArrow(_best_of_chunk(top_n, threshold, reduction, tile_rows), _PAIR_SCHEMA)
        )

    if len(rounds) == 1:
        return keep_top_n(one(rounds[0]), top_n)
    best = path = None
    for parts in rounds:
        met = one(parts) if best is None else one(parts).unionByName(best)
        before, path = path, work_folder(spark, "best")
        with shuffles_dropped(spark):
            keep_top_n(met, top_n).write.parquet(path)
        best = spark.read.schema(_PAIR_SCHEMA).parquet(path)
        if before:
            discard(spark, before)
    for path in spent:
        discard(spark, path)
    return best


def _dimension(vectors: DataFrame) -> int:
    row = vectors.select(F.size("vector").alias("n")).first()
    return row["n"] if row else 1


def _chunk_rows(references: DataFrame) -> int:
    """Rows of one chunk: as many vectors as fit in CHUNK_BYTES, and as make GROUP_PAIRS with as many of the other side."""
    return max(1024, min(CHUNK_BYTES // (4 * max(_dimension(references), 1)), math.isqrt(GROUP_PAIRS)))


def _rows_per_cell(sent: DataFrame) -> dict[int, int]:
    return {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()}


# ---------------------------------------------------------------------------
# exact join
# ---------------------------------------------------------------------------

def knn_join(
    queries: DataFrame,
    references: DataFrame,
    top_n: int = TOP_N,
    threshold: float | None = None,
    cell_rows: int | None = None,
    chunk_rows: int | None = None,
    axes: int | None = None,
) -> DataFrame:
    """For each query row its ``top_n`` nearest reference rows with
    ``similarity`` = 1 - d^2/2; rows below ``threshold`` are then dropped, and a
    query left without rows does not appear.

    Rows below the threshold never displace others, so the threshold also
    shrinks the search: cells out of its reach are skipped.

    References that fit in one chunk are one cell; more are split into cells of
    about ``cell_rows`` rows (CELL_ROWS).  ``chunk_rows`` of them are compared at once; what is shuffled together does not
    follow it, as every query is sent to every chunk that may hold its neighbours.

    Inside a cell most pairs can be ruled out by the few ``axes`` along which the vectors spread most
    (None: as many as the pivots of the cells call for, none if the spread is even; 0: never).  The
    result is the same for any number.
    """
    return knn_found(queries, references, top_n, threshold, cell_rows, chunk_rows, axes).rows()


def knn_found(
    queries: DataFrame, references: DataFrame, top_n: int = TOP_N, threshold: float | None = None,
    cell_rows: int | None = None, chunk_rows: int | None = None, axes: int | None = None,
) -> Found:
    """:func:`knn_join` before names and addresses are joined."""
    q, r = _query_side(queries), _reference_side(references)
    reference_count, query_count = r.count(), q.count()
    tile_rows, chunk_rows = chunk_rows, _chunk_rows(r)
    if cell_rows is None:
        cell_rows = chunk_rows if reference_count <= chunk_rows else CELL_ROWS
    cells = max(1, min(most_cells(_dimension(r)), -(-reference_count // cell_rows)))
    reduction = None
    if axes and reference_count:
        # a few thousand vectors tell the axes
        reduction = principal_axes(_pick_centres(r, AXES_SAMPLE, reference_count), axes)
    no_lists = F.lit(None).cast("array<int>").alias("lists")
    if cells == 1:
        found = _meet(
            q.select("*", F.lit(0).alias("cell"), no_lists), r.withColumns({"cell": F.lit(0), "list": F.lit(0)}),
            {0: reference_count}, {0: query_count}, top_n, threshold, chunk_rows, reduction, tile_rows,
        )
        return Found(found, queries, references, _some_twice(r))
    centres = _check_centres(_pick_centres(r, cells, reference_count))
    if axes is None:
        reduction = principal_axes(centres)
    spark = queries.sparkSession
    spent = work_folder(spark, "assigned"), work_folder(spark, "aimed")
    assigned = written(assign_cells(r, centres), spent[0])
    known = _describe_cells(assigned, centres, top_n)
    reach = math.inf if threshold is None else math.sqrt(max(0.0, 2.0 * (1.0 - threshold)))
    order, first = _regions(centres, known.rows, chunk_rows)
    region = _region_of(order, first)

    def choose(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        row, cell = np.nonzero(np.logical_or.reduceat(_cells_to_search(points, known, top_n, reach)[:, order], first, axis=1))
        return row, cell, pa.nulls(len(row), pa.list_(pa.int32()))

    aimed = written(_aimed(q, choose), spent[1])
    sent = _send_to_cells(aimed)
    assigned = assigned.withColumn("cell", F.element_at(F.lit(region.tolist()), F.col("cell") + 1).cast("int"))
    query_rows = _rows_per_cell(sent)
    rows = np.bincount(region, known.rows, len(first))
    reference_rows = {c: int(n) for c, n in enumerate(rows) if n}
    twice = _some_twice(assigned)
    found = _meet(
        sent, assigned.withColumn("list", F.lit(0)), reference_rows, query_rows, top_n, threshold, chunk_rows, reduction, tile_rows, aimed, spent,
    )
    return Found(found, queries, references, twice)


# ---------------------------------------------------------------------------
# approximate join over clustered references
# ---------------------------------------------------------------------------

def fit_centres(references: DataFrame, lists: int | None = None, seed: int = 42) -> np.ndarray:
    """K-means centres of all vectors, of either kind of table."""
    r = references.where("vector IS NOT NULL").select(F.col("vector").cast("array<float>").alias("vector"))
    most = most_cells(_dimension(r))
    lists = min(auto_lists(r.count()), most) if lists is None else lists
    if lists > most:
        raise ValueError(f"at most {most} lists of this dimension")
    features = r.select(array_to_vector("vector").alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=10, initMode="random").fit(features)
    return _check_centres(np.array(model.clusterCenters(), dtype=np.float64))


def with_list_id(references: DataFrame, centres: np.ndarray | CentreTree) -> DataFrame:
    """Reference rows with the ``list_id`` to write them under."""
    assigned = assign_cells(references.where("vector IS NOT NULL"), centres)
    return assigned.withColumnRenamed("cell", "list_id").drop("centre_distance")


def ivf_join(
    queries: DataFrame,
    listed: DataFrame,
    centres: np.ndarray | CentreTree,
    top_n: int = TOP_N,
    threshold: float | None = None,
    probes: int | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """As :func:`knn_join`, but each query searches its ``probes`` nearest lists
    only.  ``listed`` carries ``list_id`` (see :func:`with_list_id`)."""
    return ivf_found(queries, listed, centres, top_n, threshold, probes, chunk_rows).rows()


def ivf_found(
    queries: DataFrame, listed: DataFrame, centres: np.ndarray | CentreTree, top_n: int = TOP_N,
    threshold: float | None = None, probes: int | None = None, chunk_rows: int | None = None,
) -> Found:
    """:func:`ivf_join` before names and addresses are joined."""
    probes = auto_probes(len(centres)) if probes is None else probes
    spark = queries.sparkSession
    r = _reference_side(listed, "list_id")
    list_rows = _rows_per_cell(r.select(F.col("list_id").alias("cell")))
    tile_rows, chunk_rows = chunk_rows, _chunk_rows(r)
    if not list_rows:
        return Found(spark.createDataFrame([], _PAIR_SCHEMA), queries, listed, False)
    rows = np.zeros(len(centres), dtype=np.int64)
    rows[list(list_rows)] = list(list_rows.values())
    filled = rows > 0
    order, first = _regions(centres, rows, chunk_rows)
    region = _region_of(order, first)
    in_region = np.bincount(region, filled, len(first)).astype(np.int64)
    if isinstance(centres, CentreTree):
        nearest = centres.search(filled, probes)
    else:
        nearest = lambda points: np.nonzero(_cells_to_probe(points, centres, filled, probes))
    spent = work_folder(spark, "listed"), work_folder(spark, "aimed")
    aimed = written(_aimed(_query_side(queries), lambda points: _by_region(*nearest(points), region, in_region)), spent[1])
    sent = _send_to_cells(aimed)
    query_rows = _rows_per_cell(sent)
    # of a table partitioned by list only the lists in use are read
    asked = sent.select(F.when(F.col("lists").isNull(), F.col("cell")).alias("cell"), F.explode_outer("lists").alias("list")).distinct().collect()
    used = {x["list"] for x in asked if x["list"] is not None} | {
        n for x in asked if x["cell"] is not None for n in np.flatnonzero(filled & (region == x["cell"])).tolist()
    }
    if len(used) < len(list_rows):
        r = r.where(F.col("list_id").isin(sorted(used)))
        rows[[n for n in list_rows if n not in used]] = 0
    at = F.element_at(F.lit(region.tolist()), F.col("list_id") + 1).cast("int")
    # read again in every round, and by a caller perhaps not stored
    assigned = written(r.select(*_REFERENCE_COLUMNS, "vector", F.col("list_id").cast("int").alias("list"), at.alias("cell")), spent[0])
    reference_rows = {c: int(n) for c, n in enumerate(np.bincount(region, rows, len(first))) if n}
    twice = _some_twice(assigned)
    found = _meet(
        sent, assigned, reference_rows, query_rows, top_n, threshold, chunk_rows, tile_rows=tile_rows, aimed=aimed, spent=spent,
    )
    return Found(found, queries, listed, twice)


def save_centres(spark: SparkSession, centres: np.ndarray | CentreTree, path: str) -> None:
    """The centres as a table beside the list-partitioned vectors; a tree's nodes with their parents."""
    if isinstance(centres, CentreTree):
        centres.save(spark, path)
        return
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "list_id int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_centres(spark: SparkSession, path: str) -> np.ndarray | CentreTree:
    """The stored centres, at most ``MAX_CELLS`` rows, or the nodes of a tree, at most ``MAX_TREE_NUMBERS`` numbers."""
    stored = spark.read.parquet(path)
    if "parent" in stored.columns:
        nodes = stored.orderBy("node").collect()
        return CentreTree(np.array([r["centre"] for r in nodes], dtype=np.float32), np.array([r["parent"] for r in nodes]))
    rows = stored.orderBy("list_id").collect()
    return _check_centres(np.array([r["centre"] for r in rows], dtype=np.float64))


def recall_share(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: how many of the true neighbour pairs were found."""
    keys = ["enterprise_id", "standard_id"]
    joined = truth.select(*keys).join(found.select(*keys, F.lit(True).alias("hit")), keys, "left")
    return joined.agg(
        F.count("*").alias("true_pairs"),
        F.count("hit").alias("found_pairs"),
        (F.count("hit") / F.greatest(F.count("*"), F.lit(1))).alias("recall"),
    )


# ---------------------------------------------------------------------------
# one query vector
# ---------------------------------------------------------------------------

def search(references: DataFrame, vector: Column | list[float], top_n: int = TOP_N) -> DataFrame:
    """The ``top_n`` reference rows nearest to one vector, nearest first."""
    point = vector if isinstance(vector, Column) else F.array(*[F.lit(float(x)) for x in vector])
    scored = references.where("vector IS NOT NULL").withColumn("_squared", squared_l2(F.col("vector"), point))
    return (
        scored.orderBy(F.round("_squared", TIE_DIGITS), "source_id").limit(top_n)
        .withColumn("similarity", 1.0 - F.col("_squared") / 2.0).drop("_squared", "vector")
    )
