"""Native text encoder: hashed counts of character pairs, as a unit vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from addrloom.functions import text as tx
from addrloom.functions.once import computed_once
from addrloom.models.char_pairs import char_pairs
from addrloom.vocab import VECTOR_DIM

# fixed values: weights of the two code points in the slot number
FIRST_WEIGHT, SECOND_WEIGHT = 8191, 131
ROWS_AT_ONCE = 1024


def _unit_vectors(texts: list[str], dim: int) -> np.ndarray:
    """Rows x dim: every pair of neighbouring characters of a text (framed by code
    point 0) counts in its slot; rows have length 1."""
    row, first, second = char_pairs(texts)
    slots = (first * FIRST_WEIGHT + second * SECOND_WEIGHT) % dim
    counts = np.bincount(row * dim + slots, minlength=len(texts) * dim).reshape(len(texts), dim)
    return (counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True))).astype(np.float32)


class CharPairEncoder:
    """Slot of a pair = (first * 8191 + second * 131) mod ``dim``.  Linear in the
    text, Arrow batches in and out, no shuffle.  A blank text has no vector
    (NULL)."""

    def __init__(self, dim: int = VECTOR_DIM, text: str = "address", vector: str = "vector"):
        self.dim, self.text, self.vector = dim, text, vector

    def transform(self, df: DataFrame) -> DataFrame:
        dim = self.dim

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def encode(texts: pa.Array) -> pa.Array:
            pieces = []
            for start in range(0, len(texts), ROWS_AT_ONCE):
                part = texts.slice(start, ROWS_AT_ONCE).to_pylist()
                filled = [t for t in part if t]
                flat = _unit_vectors(filled, dim).ravel() if filled else np.empty(0, dtype=np.float32)
                sizes = np.array([0] + [dim if t else 0 for t in part])
                blank = pa.array([not t for t in part] + [False])
                offsets = pa.array(np.cumsum(sizes).astype(np.int32))
                pieces.append(pa.ListArray.from_arrays(offsets, pa.array(flat), mask=blank[:-1]))
            return pa.concat_arrays(pieces) if pieces else pa.array([], pa.list_(pa.float32()))

        text = tx.strip(F.coalesce(self.text, F.lit("")))
        return computed_once(df.withColumn(self.vector, encode(text)), self.vector)
