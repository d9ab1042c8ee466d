"""A result stored in order, so that a page of any depth reads the one or two files it lies in.

``pages.page`` sorts all rows for every page.  Here one range shuffle puts the rows in order once: each part is one
range, and each row carries its place in its part.  A small directory beside them tells how many rows come before every
part.  A page is found there, and only the parts it touches are opened.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from addrloom.sources.tables import written

FILE_ROWS = 100_000
# The driver holds one count per part; larger tables get larger parts.
MOST_PARTS = 200_000
_PLACE, _PART = "_place", "_part"


def _paths(path: str) -> tuple[str, str]:
    return f"{path.rstrip('/')}/rows", f"{path.rstrip('/')}/directory"


def store(rows: DataFrame, order: Sequence[Column | str], path: str, file_rows: int = FILE_ROWS) -> None:
    """Store ``rows`` in ``order`` at ``path``, which must be new, in parts of about ``file_rows`` rows.

    Rows that are equal in ``order`` lie in some fixed order and may be cut into several parts, however many they are.  An
    empty table has no pages.  The directory is written last, so a store that died cannot be read.  Columns named
    ``_place`` or ``_part`` give an error.
    """
    taken = {_PLACE, _PART} & {c.lower() for c in rows.columns}
    if taken:
        raise ValueError(f"column names in use: {sorted(taken)}")
    spark = rows.sparkSession
    at, directory = _paths(path)
    rows = written(rows, "page-rows")  # sampled for the ranges, then sorted
    parts = max(1, min(MOST_PARTS, math.ceil(rows.count() / file_rows)))
    # the row's place in the stored table, as the last key, divides equal rows
    key = [*order, F.monotonically_increasing_id()]
    placed = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn(_PLACE, F.monotonically_increasing_id())
    # that id is the part above 33 bits and the place in it below
    split = {_PART: F.shiftright(_PLACE, 33).cast("int"), _PLACE: F.col(_PLACE).bitwiseAND((1 << 33) - 1)}
    placed.withColumns(split).write.partitionBy(_PART).parquet(at)
    stored = T.StructType([*rows.schema, T.StructField(_PLACE, T.LongType())])
    counts = spark.read.schema(T.StructType([*stored, T.StructField(_PART, T.IntegerType())])).parquet(at).groupBy(_PART)
    before, lines = 0, [(-1, 0, 0, stored.json())]  # the layout, also of a table without rows
    for r in counts.agg(F.count(F.lit(1)).alias("n")).orderBy(_PART).collect():  # a row a part
        lines.append((r[_PART], r["n"], before, stored.json()))
        before += r["n"]
    spark.createDataFrame(lines, "part int, rows long, before long, layout string").coalesce(1).write.parquet(directory)


def page(spark: SparkSession, path: str, number: int = 1, size: int = 20) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows; beyond the last page, no rows."""
    at, directory = _paths(path)
    lines = spark.read.parquet(directory)
    layout = T.StructType.fromJson(json.loads(lines.select("layout").first()["layout"]))
    first = (max(number, 1) - 1) * size
    touched = lines.where((F.col("before") < first + size) & (F.col("before") + F.col("rows") > first)).collect()
    if not touched:
        return spark.createDataFrame([], T.StructType(layout.fields[:-1]))
    files = spark.read.schema(layout).option("basePath", at).parquet(*[f"{at}/{_PART}={r['part']}" for r in touched])
    inside = [
        (F.col(_PART) == r["part"]) & F.col(_PLACE).between(first - r["before"], first + size - 1 - r["before"]) for r in touched
    ]
    return files.where(reduce(lambda a, b: a | b, inside)).orderBy(_PART, _PLACE).drop(_PART, _PLACE)


def total(spark: SparkSession, path: str) -> int:
    """Rows of the stored result, from its directory."""
    return spark.read.parquet(_paths(path)[1]).agg(F.sum("rows").alias("n")).first()["n"] or 0
