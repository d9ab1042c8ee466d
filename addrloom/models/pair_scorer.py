"""Native pair scorer: six agreement features and a multinomial logit."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from addrloom.functions.once import computed_once
from addrloom.functions.scores import softmax3
from addrloom.models.char_pairs import char_pairs

ROWS_AT_ONCE = 1024
FEATURES = ("pair_share", "pair_cover", "number_share", "first_number", "letter_share", "length_ratio")

# Fitted on generated pairs of all three classes (see plans/evaluation.py):
# one row per class (none, partial, exact); intercept first, then FEATURES.
DEFAULT_WEIGHTS = (
    (18.24, -11.64, -12.70, -0.54, -0.54, 0.05, -5.69),
    (10.74, -2.55, 0.61, -1.17, -1.17, -2.57, -3.89),
    (-28.98, 14.19, 12.10, 1.72, 1.72, 2.52, 9.58),
)


@F.arrow_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("a", "b", "both")]))
def _pair_counts(a: pa.Array, b: pa.Array) -> pa.Array:
    """Distinct neighbouring characters of each text, and how many both have."""

    def distinct(texts: list[str]) -> np.ndarray:
        row, first, second = char_pairs(texts)
        return np.unique((row << 42) | (first << 21) | second)

    def per_row(keys: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(keys >> 42, minlength=rows).astype(np.int32)

    counts: list[list[np.ndarray]] = [[], [], []]
    for start in range(0, len(a), ROWS_AT_ONCE):
        left, right = (x.slice(start, ROWS_AT_ONCE).fill_null("").to_pylist() for x in (a, b))
        ka, kb = distinct(left), distinct(right)
        for out, keys in zip(counts, (ka, kb, np.intersect1d(ka, kb, assume_unique=True))):
            out.append(per_row(keys, len(left)))
    arrays = [pa.array(np.concatenate(c) if c else np.empty(0, dtype=np.int32)) for c in counts]
    return pa.StructArray.from_arrays(arrays, names=["a", "b", "both"])


def _runs_of(text: Column, kind: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"([{kind}]+)")))


def _share(common: Column, a: Column, b: Column) -> Column:
    return F.when(a + b == 0, F.lit(1.0)).otherwise(common / F.greatest(a + b - common, F.lit(1)))


def with_features(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two texts: shared character pairs over all and over the fewer,
    shared numbers over all, same first number, shared Latin words over all
    (each 1 when neither text has one), shorter length over longer."""
    df = computed_once(df.withColumn("_pairs", _pair_counts(F.col(a), F.col(b))), "_pairs")
    sets = {
        f"_{kind}{side}": _runs_of(F.col(text), letters)
        for side, text in (("a", a), ("b", b))
        for kind, letters in (("n", "0-9"), ("l", "A-Za-z"))
    }
    df = df.withColumns(sets)
    df = df.withColumns({f"_{k}c": F.size(F.array_intersect(f"_{k}a", f"_{k}b")) for k in "nl"})
    size = lambda name: F.size(f"_{name}")
    pa_, pb_, pc_ = (F.col(f"_pairs.{n}") for n in ("a", "b", "both"))
    la, lb = F.char_length(a), F.char_length(b)
    first = lambda name: F.coalesce(F.get(F.col(f"_{name}"), F.lit(0)), F.lit(""))
    df = df.withColumns(
        {
            "pair_share": _share(pc_, pa_, pb_),
            "pair_cover": pc_ / F.greatest(F.least(pa_, pb_), F.lit(1)),
            "number_share": _share(F.col("_nc"), size("na"), size("nb")),
            "first_number": (first("na") == first("nb")).cast("double"),
            "letter_share": _share(F.col("_lc"), size("la"), size("lb")),
            "length_ratio": F.least(la, lb) / F.greatest(la, lb, F.lit(1)),
        }
    ).drop(*sets, "_nc", "_lc", "_pairs")
    return computed_once(df, *FEATURES)


class LogitPairScorer:
    """Adds ``exact_match``, ``partial_match``, ``not_match`` from the agreement of
    the two texts; the weights are a 3 x 7 parameter."""

    def __init__(
        self, weights: Sequence[Sequence[float]] = DEFAULT_WEIGHTS, a: str = "address_a", b: str = "address_b"
    ):
        self.weights, self.a, self.b = weights, a, b

    def transform(self, df: DataFrame) -> DataFrame:
        df = with_features(df, self.a, self.b)

        def logit(row: Sequence[float]) -> Column:
            total = F.lit(float(row[0]))
            for weight, name in zip(row[1:], FEATURES):
                total = total + F.col(name) * float(weight)
            return total

        df = df.withColumns({f"_z{i}": logit(row) for i, row in enumerate(self.weights)})
        scores = softmax3(F.col("_z0"), F.col("_z1"), F.col("_z2"))
        return df.withColumns(scores).drop(*FEATURES, "_z0", "_z1", "_z2")


def fit_pair_scorer(
    labelled: DataFrame, a: str = "address_a", b: str = "address_b", label: str = "class_index"
) -> LogitPairScorer:
    """Fit the weights on labelled pairs (class index 0 none, 1 partial, 2 exact)."""
    rows = with_features(labelled, a, b).select(
        F.col(label).cast("double").alias("label"), array_to_vector(F.array(*FEATURES)).alias("features")
    )
    model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=200).fit(rows)
    matrix, start = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    weights = [[float(start[i]), *[float(x) for x in matrix[i]]] for i in range(3)]
    return LogitPairScorer(weights, a, b)


class SimilarityScorer:
    """Scores from the recall similarity alone: three straight-line logits,
    softmaxed.  A stand-in where no pair model is wanted."""

    def __init__(
        self,
        exact: tuple[float, float] = (8.0, 0.0),
        partial: tuple[float, float] = (0.0, 2.75),
        not_match: tuple[float, float] = (-4.0, 4.0),
        similarity: str = "similarity",
    ):
        self.lines, self.similarity = (not_match, partial, exact), similarity

    def transform(self, df: DataFrame) -> DataFrame:
        s = F.col(self.similarity)
        return df.withColumns(softmax3(*[s * slope + start for slope, start in self.lines]))
