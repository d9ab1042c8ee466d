"""Stages around a model the user brings (a callable on batches of text)."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from addrloom.functions.entities import clean_tokens

Loader = Callable[[], Callable[..., Sequence[Any]]]

# Rows and padded characters a batch shown to a model.
BATCH_ROWS = 256
BATCH_CHARS = 64 * 1024
# Rows, and bytes of all their columns, that are ordered by length at a time.
POOL_ROWS = 8192
POOL_BYTES = 32 * 1024 * 1024
# Models a worker process keeps.
KEPT_MODELS = 2


def _per_batch_or_row(run: Callable[..., Sequence[Any]], *columns: list[str]) -> tuple[list[Any], list[str | None]]:
    """Results and errors of one batch.  If the batch fails, its rows are tried
    one at a time, so that a bad row costs only itself."""
    try:
        return list(run(*columns)), [None] * len(columns[0])
    except Exception:
        results: list[Any] = []
        errors: list[str | None] = []
        for row in zip(*columns):
            try:
                results.append(list(run(*[[v] for v in row]))[0])
                errors.append(None)
            except Exception as failure:
                results.append(None)
                errors.append(f"{type(failure).__name__}: {failure}")
        return results, errors


def _model(key: str, load: Loader) -> Callable[..., Sequence[Any]]:
    """The model of this worker process: loaded by the first task that needs it, kept for the later ones.
    The last ``KEPT_MODELS`` are kept."""
    # this module travels with every task, so the place that outlives one is a module of the process
    kept = sys.modules.setdefault("_models_of_this_worker", types.ModuleType("_models_of_this_worker")).__dict__.setdefault("models", {})
    model = kept.pop(key, None) or load()
    kept[key] = model
    for old in list(kept)[:-KEPT_MODELS]:
        del kept[old]
    return model


def _cuts(lengths: list[int], batch_rows: int, batch_chars: int) -> Iterator[list[int]]:
    """Places in order of length, in batches: no more than ``batch_rows`` rows, and no more than
    ``batch_chars`` characters when all are padded to the longest (a longer text is a batch alone)."""
    batch: list[int] = []
    for place in sorted(range(len(lengths)), key=lengths.__getitem__):
        if batch and (len(batch) >= batch_rows or (len(batch) + 1) * lengths[place] > batch_chars):
            yield batch
            batch = []
        batch.append(place)
    if batch:
        yield batch


def _pools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Arriving rows in pools of about ``POOL_ROWS`` rows or ``POOL_BYTES`` bytes, whichever comes first."""
    pool: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        step = max(1, min(POOL_ROWS, batch.num_rows * POOL_BYTES // max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            if pool and (rows + part.num_rows > POOL_ROWS or size + part.nbytes > POOL_BYTES):
                yield pa.Table.from_batches(pool)
                pool, rows, size = [], 0, 0
            pool.append(part)
            rows += part.num_rows
            size += part.nbytes
    if pool:
        yield pa.Table.from_batches(pool)


class _Plugged:
    """A stage of a user's model.  ``load()`` runs once a worker process.  The texts of a pool of rows are
    shown in batches of like length (``batch_rows`` rows, ``batch_chars`` padded characters at most),
    which keeps padding low; rows come out in the order in which they came in.  A NULL text is shown as None
    and counts as empty."""

    def __init__(self, load: Loader, batch_rows: int = BATCH_ROWS, batch_chars: int = BATCH_CHARS):
        if batch_rows < 1 or batch_chars < 1:
            raise ValueError("a batch holds at least one row and one character")
        self.load, self.batch_rows, self.batch_chars = load, batch_rows, batch_chars
        self._key = uuid.uuid4().hex

    def _stage(self, df: DataFrame, inputs: list[str], added: list[tuple[str, T.DataType, pa.DataType]], write: Callable) -> DataFrame:
        load, key, batch_rows, batch_chars = self.load, self._key, self.batch_rows, self.batch_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pool in _pools(batches):
                model = _model(key, load)
                texts = [pool.column(c).to_pylist() for c in inputs]
                results: list[Any] = [None] * pool.num_rows
                errors: list[str | None] = [None] * pool.num_rows
                for places in _cuts([sum(len(t or "") for t in row) for row in zip(*texts)], batch_rows, batch_chars):
                    got, why = _per_batch_or_row(model, *[[t[p] for p in places] for t in texts])
                    for place, result, error in zip(places, got, why):
                        results[place], errors[place] = result, error
                columns = list(zip(*[write(r) for r in results]))
                extra = [pa.array(c, kind) for c, (_, _, kind) in zip(columns, added)] + [pa.array(errors, pa.string())]
                names = [*pool.column_names, *[n for n, _, _ in added], "error"]
                yield from pa.table([*pool.columns, *extra], names=names).combine_chunks().to_batches()

        fields = [T.StructField(n, kind) for n, kind, _ in added]
        return df.mapInArrow(run, T.StructType([*df.schema, *fields, T.StructField("error", T.StringType())]))


class PluggedEncoder(_Plugged):
    """``load()`` gives ``f(texts) -> vectors``.  Failed rows get a NULL vector
    (never an invented one) and the reason in ``error``."""

    def __init__(self, load: Loader, text: str = "address", vector: str = "vector", **batches: int):
        super().__init__(load, **batches)
        self.text, self.vector = text, vector

    def transform(self, df: DataFrame) -> DataFrame:
        added = [(self.vector, T.ArrayType(T.FloatType()), pa.list_(pa.float32()))]
        return self._stage(df, [self.text], added, lambda r: (None if r is None else [float(x) for x in r],))


class PluggedPairScorer(_Plugged):
    """``load()`` gives ``f(a, b) -> [(not, partial, exact)]``.  Failed rows get
    the no-match verdict 0 / 0 / 1."""

    def __init__(self, load: Loader, a: str = "address_a", b: str = "address_b", **batches: int):
        super().__init__(load, **batches)
        self.a, self.b = a, b

    def transform(self, df: DataFrame) -> DataFrame:
        added = [(n, T.DoubleType(), pa.float64()) for n in ("not_match", "partial_match", "exact_match")]
        return self._stage(
            df, [self.a, self.b], added,
            lambda r: (1.0, 0.0, 0.0) if r is None else tuple(float(x) for x in r),
        )


class PluggedTagger(_Plugged):
    """``load()`` gives ``f(texts) -> [(tokens, labels)]``.  Failed rows get no
    tokens, and with them empty fields.  Special tokens and sub-word marks of the
    model's tokenizer are removed."""

    def __init__(self, load: Loader, text: str = "address", **batches: int):
        super().__init__(load, **batches)
        self.text = text

    def transform(self, df: DataFrame) -> DataFrame:
        added = [(n, T.ArrayType(T.StringType()), pa.list_(pa.string())) for n in ("tokens", "labels")]
        labelled = self._stage(df, [self.text], added, lambda r: ([], []) if r is None else (list(r[0]), list(r[1])))
        return clean_tokens(labelled)
