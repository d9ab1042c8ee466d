"""CSV files in mixed encodings, and CSV export."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom.schemas import require_columns
from addrloom.vocab import CSV_ENCODINGS

# fixed values: Python codec -> Java charset of the CSV reader
_JAVA_CHARSET = {
    "utf-8-sig": "UTF-8", "utf-8": "UTF-8", "gbk": "GBK", "gb2312": "GB2312", "gb18030": "GB18030",
    "latin1": "ISO-8859-1",
}
_JVM_DEFAULT_CHARSETS = ("UTF-8", "ISO-8859-1")


def detect_encodings(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``encoding``: the first of the known encodings that decodes
    every line of the file.

    Lines are read as raw bytes, in splits, so a file of any size is checked in
    parallel; none of these encodings uses the line feed byte inside a
    character.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        excluded: set[tuple[str, str]] = set()

        def decodes(file: str, text: bytes, codec: str) -> bool:
            if (file, codec) in excluded:
                return False
            try:
                text.decode(codec)
                return True
            except UnicodeDecodeError:
                excluded.add((file, codec))
                return False

        for batch in batches:
            # all lines of a file in a batch at once: one that fails excludes the codec anyway
            texts = {f: b"\n".join(map(bytes, lines)) for f, lines in batch.groupby("file")["line"]}
            yield pd.DataFrame([{"file": f, **{c: decodes(f, t, c) for c in CSV_ENCODINGS}} for f, t in texts.items()])

    lines = (
        spark.read.option("lineSep", "\n").text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    )
    flags = ", ".join(f"`{c}` boolean" for c in CSV_ENCODINGS)
    checked = lines.mapInPandas(check, f"file string, {flags}").groupBy("file").agg(
        *[F.bool_and(f"`{c}`").alias(c) for c in CSV_ENCODINGS]
    )
    first = F.coalesce(*[F.when(F.col(f"`{c}`"), F.lit(c)) for c in CSV_ENCODINGS], F.lit("utf-8"))
    return checked.select("file", first.alias("encoding"))


def _allow_charsets(spark: SparkSession, charsets) -> None:
    """Spark 4 knows the Chinese code pages only with this switch.  It stays on, as reading is lazy."""
    if any(c not in _JVM_DEFAULT_CHARSETS for c in charsets):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_csv(
    spark: SparkSession, path: str, *required: str | None, infer_schema: bool = False, multi_line: bool = False
) -> DataFrame:
    """CSV files with a header, each decoded by its detected encoding.  One read
    per encoding found (at most six), united by column name.  ``multi_line`` is
    for quoted fields with line breaks; such a file is not split."""
    files: dict[str, list[str]] = {}
    for row in detect_encodings(spark, path).collect():  # one short row per file
        files.setdefault(_JAVA_CHARSET[row["encoding"]], []).append(row["file"])
    if not files:
        raise ValueError(f"no CSV rows under {path}")
    _allow_charsets(spark, files)
    parts = [
        spark.read.option("header", True).option("encoding", charset).option("inferSchema", infer_schema)
        .option("multiLine", multi_line).option("escape", '"').csv(sorted(paths))
        for charset, paths in sorted(files.items())
    ]
    return require_columns(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), *required)


def write_csv(
    df: DataFrame, path: str, rows_per_file: int | None = None, byte_order_mark: bool = False, encoding: str = "utf-8",
) -> None:
    """Export with a header in every piece.  ``rows_per_file`` limits a piece (a
    spreadsheet-sized 5000, say); left out, pieces follow the partitions.  ``encoding`` is
    one of the known ones."""
    charset = _JAVA_CHARSET[encoding]
    _allow_charsets(df.sparkSession, [charset])
    if byte_order_mark and df.columns:
        # a mark in front of the first column name is the first thing in each file
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", charset)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.csv(path)


def write_statistics(stats: DataFrame, path: str) -> None:
    """A one-row statistics table as one CSV file."""
    stats.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
