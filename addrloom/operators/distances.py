"""Vectors of Arrow batches as matrices, and distances between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an ``array<float>`` Arrow column as a matrix of floats."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    products = a @ b.T
    products *= -2.0
    products += np.einsum("ij,ij->i", a, a)[:, None]
    products += np.einsum("ij,ij->i", b, b)[None, :]
    return np.maximum(products, 0.0, out=products)


def rough_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As :func:`squared_distances` by one product of matrices; rounding may leave a value a little below 0."""
    return np.column_stack([a, np.einsum("ij,ij->i", a, a), np.ones(len(a), a.dtype)]) @ np.column_stack(
        [-2.0 * b, np.ones(len(b), b.dtype), np.einsum("ij,ij->i", b, b)]
    ).astype(b.dtype, copy=False).T


class Reduction:
    """Vectors as a few numbers whose distances never exceed the true ones: the part along ``axes`` (orthonormal
    columns) of the centred vector, and the length of the rest."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray):
        self.mean, self.axes = mean, axes

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        # in double precision, as the rest is a difference of squares
        centred = vectors.astype(np.float64) - self.mean
        head = centred @ self.axes
        rest = np.einsum("ij,ij->i", centred, centred) - np.einsum("ij,ij->i", head, head)
        return np.column_stack([head, np.sqrt(np.maximum(rest, 0.0))]).astype(np.float32)


def principal_axes(sample: np.ndarray, axes: int | None = None, share: float = 0.9) -> Reduction | None:
    """The directions in which a sample spreads most: ``axes`` of them, or as many as hold ``share`` of its spread.
    Then None where they would be more than a quarter of all, or too many for the sample to tell."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    spread, vectors = np.linalg.eigh(centred.T @ centred)
    spread, vectors = np.maximum(spread[::-1], 0.0), vectors[:, ::-1]
    if axes is None:
        if spread.sum() <= 0:
            return None
        axes = int(np.searchsorted(np.cumsum(spread), share * spread.sum())) + 1
        if 4 * axes > min(sample.shape):
            return None
    return Reduction(mean, np.ascontiguousarray(vectors[:, : min(axes, sample.shape[1])]))
