"""Stored tables that are replaced, extended and corrected as a whole: published versions.

    path/data/_part=<token>/_cell=<n>/*.parquet     rows, never changed once published
    path/manifest/version=<n>/*.parquet             which parts' cells make up a version
    path/claims/<n>                                 made, and never made again, by the writer of a version

A change writes a part of its own and then, as the last step, one small manifest file; a folder that holds one file appears
by one rename, so readers see the old version or the new one.  A job that dies before leaves a part nobody reads, which
:func:`vacuum` removes.  As published rows stay where they are, a new version may be made from the table itself.

With a ``key`` the rows of equal keys share a cell (a hash of the key, ``cells`` of them).  A correction or a lookup by keys
then reads and rewrites only the cells of these keys; the others keep their files.  The driver holds one entry per cell and
part.  Of several writers that began from one version the first to claim the next number publishes it, and the others get an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 64
MOST_CELLS = 4096
_CELL, _PART = "_cell", "_part"
_MANIFEST = "version long, token string, row_schema string, key string, cells int, part string, cell int, rows long"


@dataclass(frozen=True)
class Version:
    """One published version: its number, layout, and (part, cell, rows) of what it is made of."""

    number: int
    token: str
    schema: T.StructType
    key: str | None
    cells: int
    held: tuple[tuple[str, int, int], ...]

    @property
    def rows(self) -> int:
        return sum(n for _, _, n in self.held)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def is_snapshots(spark: SparkSession, path: str) -> bool:
    files, where = _hadoop(spark, f"{path.rstrip('/')}/manifest")
    return files.exists(where)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path.rstrip('/')}/manifest")


def _tokens(spark: SparkSession, path: str) -> dict[int, str]:
    """The token of each published version."""
    if not is_snapshots(spark, path):
        return {}
    return {r["version"]: r["token"] for r in _manifest(spark, path).select("version", "token").distinct().collect()}


def _claims(spark: SparkSession, path: str) -> list[int]:
    files, where = _hadoop(spark, f"{path.rstrip('/')}/claims")
    return [int(f.getPath().getName()) for f in files.listStatus(where)] if files.exists(where) else []


def _next(spark: SparkSession, path: str) -> int:
    """The number after all that were published or claimed; to be read before the version that a change starts from."""
    return max([0, *_tokens(spark, path), *_claims(spark, path)]) + 1


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The version of that number, or the newest."""
    numbers = _tokens(spark, path)
    if not numbers or (number is not None and number not in numbers):
        raise ValueError(f"{path} has no version" + ("" if number is None else f" {number}"))
    number = max(numbers) if number is None else number
    rows = _manifest(spark, path).where(F.col("version") == number).collect()  # a row per cell and part
    held = tuple(sorted((r["part"], r["cell"], r["rows"]) for r in rows if r["part"]))
    first = rows[0]
    return Version(number, first["token"], T.StructType.fromJson(json.loads(first["row_schema"])), first["key"], first["cells"], held)


def _cell_of(key: str | None, cells: int):
    return F.lit(0) if key is None else F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(cells)).cast("int")


def _cells_of(keys: DataFrame, at: Version) -> set[int]:
    """The cells that the keys (first column) fall in, at most ``MOST_CELLS``."""
    named = keys.select(F.col(f"`{keys.columns[0]}`").alias(at.key))
    return {r["cell"] for r in named.select(_cell_of(at.key, at.cells).alias("cell")).distinct().collect()}


def _write(rows: DataFrame, path: str, token: str, key: str | None, cells: int) -> list[tuple[str, int, int]]:
    """The rows as a part; its cells.  Rows of a cell are brought together, and a large cell is split over several files."""
    folder = f"{path.rstrip('/')}/data/{_PART}={token}"
    dealt = rows.withColumn(_CELL, _cell_of(key, cells))
    if key is not None:
        dealt = dealt.hint("rebalance", _CELL)
    dealt.write.mode("overwrite").partitionBy(_CELL).parquet(folder)
    spark = rows.sparkSession
    if not is_filled(spark, folder):
        return []
    stored = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(_CELL, T.IntegerType())])).parquet(folder)
    return [(token, r[_CELL], r["count"]) for r in stored.groupBy(_CELL).count().collect()]


def is_filled(spark: SparkSession, folder: str) -> bool:
    files, where = _hadoop(spark, folder)
    return any(f"{_CELL}=" in f.getPath().getName() for f in files.listStatus(where))


def _publish(spark: SparkSession, path: str, number: int, token: str, schema: T.StructType, key: str | None, cells: int, held) -> Version:
    files, claim = _hadoop(spark, f"{path.rstrip('/')}/claims/{number}")
    if not files.createNewFile(claim):
        raise RuntimeError(f"another writer published version {number} of {path} at the same time")
    told = json.dumps(schema.jsonValue())
    rows = [(number, token, told, key, cells, *h) for h in held] or [(number, token, told, key, cells, None, None, 0)]
    manifest = spark.createDataFrame(rows, _MANIFEST).coalesce(1)
    manifest.write.mode("append").partitionBy("version").parquet(f"{path.rstrip('/')}/manifest")
    return version(spark, path, number)


def new_token() -> str:
    return uuid.uuid4().hex


def publish(rows: DataFrame, path: str, key: str | None = None, cells: int = CELLS, token: str | None = None) -> Version:
    """A new version made of these rows alone; they may be read from the table itself.

    Null keys share a cell.  An empty table is a version without rows.  A name given twice, or one of the store's own
    (``_cell``, ``_part``), is refused.
    """
    if not 1 <= cells <= MOST_CELLS:
        raise ValueError(f"cells must be 1 to {MOST_CELLS}")
    if len(set(rows.columns)) < len(rows.columns) or {_CELL, _PART} & set(rows.columns):
        raise ValueError(f"column names must differ, and not be {_CELL} or {_PART}")
    spark, token, cells = rows.sparkSession, token or new_token(), cells if key else 1
    number = _next(spark, path)
    held = _write(rows, path, token, key, cells)
    return _publish(spark, path, number, token, rows.schema, key, cells, held)


def has(spark: SparkSession, path: str, token: str) -> bool:
    """Whether a change of this token was published."""
    return token in _tokens(spark, path).values()


def append(rows: DataFrame, path: str, token: str | None = None) -> Version:
    """A new version with these rows besides those there are.  A token that was published before adds nothing, so a
    step that is repeated after a failure counts once."""
    spark = rows.sparkSession
    if token and has(spark, path, token):
        return version(spark, path)
    number, at, token = _next(spark, path), version(spark, path), token or new_token()
    named = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in at.schema.fields])
    held = _write(named, path, token, at.key, at.cells)
    return _publish(spark, path, number, token, at.schema, at.key, at.cells, [*at.held, *held])


def rewrite(spark: SparkSession, path: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame], token: str | None = None) -> Version:
    """A new version in which ``change`` was applied to the rows of the cells that the ``keys`` (first column) fall in.  All
    other cells keep their files.  ``change`` sees whole cells, so also rows of other keys, and returns the same columns."""
    number, at, token = _next(spark, path), version(spark, path), token or new_token()
    if at.key is None:
        raise ValueError(f"{path} was published without a key")
    cells = _cells_of(keys, at)
    touched = [h for h in at.held if h[1] in cells]
    if not touched:
        return at
    changed = change(_read(spark, path, at, touched)).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in at.schema.fields])
    held = _write(changed, path, token, at.key, at.cells)
    rest = [h for h in at.held if h[1] not in cells]
    return _publish(spark, path, number, token, at.schema, at.key, at.cells, [*rest, *held])


def _read(spark: SparkSession, path: str, at: Version, held) -> DataFrame:
    base = f"{path.rstrip('/')}/data"
    folders = [f"{base}/{_PART}={part}/{_CELL}={cell}" for part, cell, _ in held]
    if not folders:
        return spark.createDataFrame([], at.schema)
    full = T.StructType([*at.schema.fields, T.StructField(_PART, T.StringType()), T.StructField(_CELL, T.IntegerType())])
    return spark.read.schema(full).option("basePath", base).parquet(*folders).drop(_PART, _CELL)


def read(spark: SparkSession, path: str, number: int | None = None, keys: DataFrame | None = None, part: str | None = None) -> DataFrame:
    """The rows of a version (the newest); with ``keys`` (first column) only of the cells these fall in, with ``part`` only
    those that the change of that token wrote."""
    at = version(spark, path, number)
    held = at.held if part is None else [h for h in at.held if h[0] == part]
    if keys is not None and at.key is not None:
        cells = _cells_of(keys, at)
        held = [h for h in held if h[1] in cells]
    return _read(spark, path, at, held)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """``version``, ``token``, ``parts`` and ``rows`` of every published version."""
    return _manifest(spark, path).groupBy("version").agg(
        F.min("token").alias("token"), F.count_distinct("part").alias("parts"), F.sum("rows").alias("rows")
    )


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove all but the newest ``keep`` versions and the parts that none of them needs; the number of parts removed.  Readers of
    an older version, and changes that are just being written, would lose their files: run it when there are none."""
    numbers = sorted(_tokens(spark, path))
    kept = numbers[-max(keep, 1):]
    needed = {h[0] for n in kept for h in version(spark, path, n).held}
    files, root = _hadoop(spark, path)
    sub = spark._jvm.org.apache.hadoop.fs.Path
    for n in set(numbers) - set(kept):
        files.delete(sub(root, f"manifest/version={n}"), True)
    for n in _claims(spark, path):
        if n < kept[0]:
            files.delete(sub(root, f"claims/{n}"), False)
    files, data = _hadoop(spark, f"{path.rstrip('/')}/data")
    removed = 0
    for entry in files.listStatus(data) if files.exists(data) else []:
        name = entry.getPath().getName()
        if name.startswith(f"{_PART}=") and name.removeprefix(f"{_PART}=") not in needed:
            removed += bool(files.delete(entry.getPath(), True))
    return removed
