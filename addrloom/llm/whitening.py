"""Whitening of embeddings by an incremental eigendecomposition.

Each partition takes its vectors one after the other: adding a vector x to m vectors with mean u changes their covariance by

    C' = m / (m + 1) * C + m / (m + 1)**2 * (x - u)(x - u)^T,

so the spectrum (eigenvalues and eigenvectors) follows by a rank-one update: deflation sets aside what the vector does not
touch, the secular equation gives the new eigenvalues between the old ones, and its terms the eigenvectors.  Two spectra are
combined likewise, by one update per eigenpair of the one and one for the distance of the means.  Partial spectra are
combined a few at a time, in tasks.  A last pass over all vectors projects the exactly centred data on the basis so found; the
small eigenproblem of that projected covariance (Rayleigh-Ritz) takes out the rounding of all updates.

Vectors are fixed-point numbers (long), so counts, sums and deviations are exact whatever the partitions are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from addrloom.llm.shared import stored

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
# vectors that one task adds, and spectra that one combines
ROWS_PER_TASK, FAN_IN = 4096, 8
# eigenvalues within this of each other, and entries below it, relative to the largest, are deflated
_TINY = 8 * np.finfo(float).eps
_MOST_STEPS = 80


# -- spectra -----------------------------------------------------------------------------------

def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of ``1 + sum(weights / (poles - x)) = 0`` for ascending different poles and positive weights: the pole each
    root is nearest to, and its distance from that.  Root i lies between pole i and the next; the last below the sum of all."""
    n = len(poles)
    above = np.append(poles[1:], poles[-1] + weights.sum())
    gap = above - poles
    half = 1.0 + (weights / ((poles - poles[:, None]) - gap[:, None] / 2)).sum(axis=1)
    # nearest pole: the one below where the function is positive half-way; the last root has none above
    right = (half < 0) & (np.arange(n) < n - 1)
    origin = np.arange(n) + right
    shifted = poles - poles[origin][:, None]
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    last = n - 1
    if half[last] < 0:
        low[last], high[last] = gap[last] / 2, gap[last]
    x = (low + high) / 2
    lower = np.tri(n)
    beyond = np.append(shifted[np.arange(last), np.arange(1, n)], np.inf)
    for _ in range(_MOST_STEPS):
        apart = shifted - x[:, None]
        terms = weights / apart
        value = 1.0 + terms.sum(axis=1)
        if (np.abs(value) <= n * np.finfo(float).eps * (1.0 + np.abs(terms).sum(axis=1))).all():
            break
        low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
        # the poles up to the root's own, and those beyond, are each taken as one pole at the end of the root's interval
        slopes = terms / apart
        slope, slope_below = slopes.sum(axis=1), (slopes * lower).sum(axis=1)
        begin, end = apart.diagonal(), beyond - x
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            a = (begin + end) * value - begin * end * slope
            b = begin * end * value
            c = value - begin * slope_below - end * (slope - slope_below)
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = x + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            # the last root has no pole beyond
            ahead = value[last] - slope[last] * begin[last]
            step[last] = x[last] + begin[last] * value[last] / ahead
        good = (step >= low) & (step <= high) & (step != 0)
        x = np.where(good, step, (low + high) / 2)
    return origin, x


def rank_one_update(values: np.ndarray, vectors: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of ``vectors diag(values) vectors^T + rho * y y^T`` where ``z = vectors^T y`` and ``rho >= 0``; values ascend."""
    size = rho * float(z @ z)
    top = max(abs(values[-1]), size)
    if size <= 0 or top <= 0:
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    # equal values: turn their vectors so that one alone meets z
    breaks = np.flatnonzero(np.diff(values) > _TINY * top) + 1
    starts = np.concatenate(([0], breaks))
    ends = np.append(breaks, len(values))
    z = z.copy()
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - a > 1:
            part = z[a:b].copy()
            norm = np.linalg.norm(part)
            if norm > 0:
                mirror = part.copy()
                mirror[0] += np.copysign(norm, part[0])
                mirror /= np.linalg.norm(mirror)
                block = vectors[:, a:b]
                block -= 2 * np.outer(block @ mirror, mirror)
                z[a:b] = 0
                z[a] = -np.copysign(norm, part[0])
    touched = np.flatnonzero(np.sqrt(rho) * np.abs(z) > _TINY * np.sqrt(top))
    if not len(touched):
        return values, vectors
    poles, weights = values[touched], rho * z[touched] ** 2
    origin, away = secular_roots(poles, weights)
    # root i less pole j, without cancellation
    apart = (poles[origin][:, None] - poles) + away[:, None]
    # the weights for which the roots found are exact make the vectors orthogonal; root i is paired with pole i below
    # pole j and with pole i + 1 from there on
    i, j = np.indices(apart.shape)
    against = np.where(i < j, poles[:, None], np.append(poles[1:], 0)[:, None]) - poles
    against[-1] = 1.0
    exact = np.prod(apart / against, axis=0)
    turn = np.sqrt(np.abs(exact)) * np.sign(z[touched]) / apart
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    vectors[:, touched] = vectors[:, touched] @ turn.T
    values[touched] = poles[origin] + away
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Of ``count`` vectors with the exact ``total``: the eigenvalues (ascending) and eigenvectors of their covariance."""

    count: int
    total: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(dimensions: int) -> Spectrum:
        return Spectrum(0, np.zeros(dimensions, np.int64), np.zeros(dimensions), np.eye(dimensions))

    def add(self, x: np.ndarray) -> None:
        m = self.count
        if m:
            # m * x less the total is exact
            off = (m * x - self.total) / m
            self.values, self.vectors = rank_one_update(self.values * (m / (m + 1)), self.vectors, self.vectors.T @ off, m / (m + 1) ** 2)
        self.count, self.total = m + 1, self.total + x

    def merge(self, other: Spectrum) -> Spectrum:
        """The spectrum of both sides' vectors; neither is empty."""
        a, b = self.count, other.count
        n = a + b
        values, vectors = self.values * (a / n), self.vectors
        for value, vector in zip(other.values, other.vectors.T):
            values, vectors = rank_one_update(values, vectors, vectors.T @ vector, max(value, 0.0) * b / n)
        off = self.total / a - other.total / b
        return Spectrum(n, self.total + other.total, *rank_one_update(values, vectors, vectors.T @ off, a / n * (b / n)))

    def row(self, part: int) -> dict:
        return {"part": part, "count": self.count, "total": self.total.tolist(), "spectrum": self.values.tolist(), "vectors": self.vectors.reshape(-1).tolist()}

    @staticmethod
    def of(row) -> Spectrum:
        values = np.array(row["spectrum"], float)
        return Spectrum(row["count"], np.array(row["total"], np.int64), values, np.array(row["vectors"], float).reshape(len(values), -1))


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists of a column, all of one length and without nulls, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# -- jobs --------------------------------------------------------------------------------------

def fixed_point(embeddings: DataFrame, carry: tuple[str, ...], vector_column: str) -> DataFrame:
    """``row`` (a struct of the carried columns) and ``x`` (array of long) of the rows that have a vector."""
    vector = F.col(f"`{vector_column}`").cast("array<double>")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = embeddings.where(F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0))
    x = F.transform(vector, lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    return rows.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("row"), x.alias("x"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Each different ``x`` once, stored.  Copies meet after they were reduced where they lie."""
    return stored(rows.select("x").distinct(), "whitening-distinct")


def _spread(distinct: DataFrame, n: int) -> DataFrame:
    """The vectors dealt to tasks by their hash, so that a lost task's share can be made again."""
    return distinct.repartition(max(1, -(-n // ROWS_PER_TASK)), "x")


def combined_spectrum(distinct: DataFrame, n: int) -> Spectrum:
    """The spectrum of the ``n`` vectors ``x``, from those of the tasks."""
    schema = pa.schema([
        ("part", pa.int64()), ("count", pa.int64()), ("total", pa.list_(pa.int64())), ("spectrum", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64())),
    ])
    columns = "part long, count long, total array<long>, spectrum array<double>, vectors array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            for x in _matrix(batch.column("x")):
                found = found or Spectrum.empty(len(x))
                found.add(x)
        if found:
            yield pa.RecordBatch.from_pylist([found.row(TaskContext.get().partitionId())], schema=schema)

    def merge(key: tuple, some: pa.Table) -> pa.Table:
        whole = None
        for row in sorted(some.to_pylist(), key=lambda r: r["part"]):
            part = Spectrum.of(row)
            whole = part if whole is None else whole.merge(part)
        return pa.Table.from_pylist([whole.row(key[0].as_py())], schema=schema)

    parts = stored(_spread(distinct, n).mapInArrow(partial, columns), "whitening-spectra")
    tasks = -(-n // ROWS_PER_TASK)
    while tasks > 1:
        grouped = parts.withColumn("into", F.expr(f"part div {FAN_IN}"))
        parts = stored(grouped.groupBy("into").applyInArrow(merge, columns), "whitening-spectra")
        tasks = -(-tasks // FAN_IN)
    return Spectrum.of(parts.first())


def _products(distinct: DataFrame, n: int, project) -> tuple[np.ndarray, np.ndarray]:
    """Sum and sum of outer products of ``project(x)`` over the vectors, added up in the tasks and then by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            y = project(_matrix(batch.column("x")))
            part = np.concatenate((y.sum(axis=0), (y.T @ y).reshape(-1)))
            sums = part if sums is None else sums + part
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["sums"])

    sums = _spread(distinct, n).mapInArrow(partial, "sums array<double>")
    added = sums.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
    flat = np.array([r["value"] for r in added.orderBy("at").collect()])  # the square of the dimensions
    d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
    return flat[:d], flat[d:].reshape(d, d)


@dataclass
class Whitening:
    """What a task needs to whiten a vector: ``axes`` has a column per component, by falling eigenvalue."""

    count: int
    total: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Count times x less the total: exact."""
        return self.count * x - self.total

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.count) @ self.axes / np.sqrt(self.values)


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening to at most ``components`` components, by the different vectors ``x``; None without vectors.  Components
    without variance (an eigenvalue that is zero but for rounding) are left out."""
    n = distinct.count()
    if not n:
        return None
    spectrum = combined_spectrum(distinct, n)
    basis, _ = np.linalg.qr(spectrum.vectors[:, ::-1])
    count, total = spectrum.count, spectrum.total
    mean, products = _products(distinct, n, lambda x: ((count * x - total) / count) @ basis)
    values, turn = np.linalg.eigh(products / count - np.outer(mean / count, mean / count))
    values, turn = values[::-1], turn[:, ::-1]
    kept = min(components, int((values > len(values) * np.finfo(float).eps * max(values[0], 0)).sum()))
    return Whitening(count, total, basis @ turn[:, :kept], values[:kept], float(values.sum()))


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity."""
    if not len(model.values):
        return 0.0
    sums, products = _products(distinct, model.count, model.whitened)
    mean = sums / model.count
    return float(np.abs(products / model.count - np.outer(mean, mean) - np.eye(len(mean))).max())


def whiten(embeddings: DataFrame, carry: tuple[str, ...] = ("vec_id",), vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per embedding: ``row`` (a struct of the carried columns), ``n`` (different vectors), ``deviation`` (n squared
    times the squared distance from the mean, exact), ``whitened`` and ``explained`` (arrays, a number per component) and
    ``identity_error``.

    Rows without a vector, with an empty one, or with a null or non-finite entry are left out, and so are those whose vector is
    not of the commonest length (of equally common ones the longest).  Repeated rows and equal vectors are fitted once
    and give a row each.  Equal eigenvalues leave their components' order open.  There are fewer components than asked for where the
    vectors vary in fewer directions, and none where all are equal.  An empty table gives no rows.  Carried names cannot clash with
    results, as they stay inside the struct.  A deviation beyond 64 bits is an error.
    """
    columns = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    rows = stored(fixed_point(embeddings, carry, vector_column), "whitening-rows")
    length = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    schema = StructType([rows.schema["row"], *StructType.fromDDL(columns).fields])
    if not length:
        return embeddings.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == length[0])
    distinct = distinct_vectors(rows)
    model = fit(distinct, components)
    error = identity_error(distinct, model)
    explained = (model.values / model.trace).tolist() if len(model.values) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            m = len(x)
            off = model.centred(x)
            most = int(np.abs(off).max()) if m else 0
            off = off if most**2 * x.shape[1] < 2**63 else off.astype(object)
            at = pa.array(np.arange(m + 1, dtype=np.int32) * len(explained))
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array(np.full(m, model.count)), pa.array((off * off).sum(axis=1).tolist(), pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(model.whitened(x).reshape(-1))),
                pa.ListArray.from_arrays(at, pa.array(np.tile(np.array(explained, float), m))), pa.array(np.full(m, error)),
            ], names=["row", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
