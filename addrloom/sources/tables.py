"""Reading input tables by the user's column names, writing result tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom import schemas
from addrloom.operators import recall as rc
from addrloom.operators.filters import valid_address
from addrloom.sources import snapshots


# -- sources --------------------------------------------------------------------

def read(spark: SparkSession, name_or_path: str, *required: str | None) -> DataFrame:
    """A catalog table, a Parquet folder or the newest version of a table of published versions, with a check of the
    columns asked for."""
    if "/" not in name_or_path:
        df = spark.table(name_or_path)
    elif snapshots.is_snapshots(spark, name_or_path):
        df = snapshots.read(spark, name_or_path)
    else:
        df = spark.read.parquet(name_or_path)
    return schemas.require_columns(df, *required)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_jdbc(
    spark: SparkSession, url: str, table: str, split_column: str, lower: int, upper: int, pieces: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A database table read by ``pieces`` parallel range scans."""
    return spark.read.jdbc(
        url, table, column=split_column, lowerBound=lower, upperBound=upper, numPartitions=pieces,
        properties=properties or {},
    )


def query_addresses(df: DataFrame, id_column: str, name_column: str | None, address_column: str) -> DataFrame:
    """id, name, address of the rows with an address; the id stands in for a
    missing name column."""
    schemas.require_columns(df, id_column, name_column, address_column)
    return df.where(valid_address(address_column)).select(
        F.col(id_column).cast("string").alias("id"),
        F.col(name_column or id_column).cast("string").alias("name"),
        F.col(address_column).cast("string").alias("address"),
    )


def reference_addresses(df: DataFrame, id_column: str, address_column: str, room_column: str | None = None) -> DataFrame:
    """id, address, room_no of the rows with an address."""
    schemas.require_columns(df, id_column, address_column, room_column)
    room = F.col(room_column).cast("string") if room_column else F.lit("")
    return df.where(valid_address(address_column)).select(
        F.col(id_column).cast("string").alias("id"),
        F.col(address_column).cast("string").alias("address"),
        F.coalesce(room, F.lit("")).alias("room_no"),
    )


def address_pairs(df: DataFrame, address_a: str, address_b: str, id_column: str | None = None) -> DataFrame:
    """identifier, address_a, address_b; nothing else is read from the source."""
    schemas.require_columns(df, address_a, address_b, id_column)
    identifier = F.col(id_column).cast("string") if id_column else F.lit("")
    return df.select(
        identifier.alias("identifier"), F.col(address_a).alias("address_a"), F.col(address_b).alias("address_b")
    )


def preview(df: DataFrame, rows: int = 5, *order: str) -> DataFrame:
    """A few rows: any, or the first by the given columns."""
    return (df.orderBy(*order) if order else df).limit(rows)


# -- result rows in table layout --------------------------------------------------

def recall_rows(recall: DataFrame) -> DataFrame:
    """Flat or nested recall results in table layout."""
    flat = rc.flatten(recall) if "candidates" in recall.columns else recall
    return schemas.fill(schemas.align(flat, schemas.RECALL, schemas.RECALL_DEFAULTS), schemas.RECALL_DEFAULTS)


def match_rows(matches: DataFrame) -> DataFrame:
    aligned = schemas.align(matches, schemas.MATCH, schemas.MATCH_DEFAULTS)
    return schemas.fill(aligned, schemas.MATCH_DEFAULTS)


def pair_rows(pairs: DataFrame) -> DataFrame:
    return schemas.fill(schemas.align(pairs, schemas.PAIRS, schemas.PAIR_DEFAULTS), schemas.PAIR_DEFAULTS)


def tagged_rows(tagged: DataFrame, mode: str) -> DataFrame:
    defaults = schemas.tagged_defaults(mode)
    return schemas.fill(schemas.align(tagged, schemas.TAGGED[mode], defaults), defaults)


def vector_rows(vectors: DataFrame, kind: str, dim: int | None = None) -> DataFrame:
    """``kind`` 'enterprise' carries the name, 'standard' the room.  With ``dim``
    a vector of another dimension fails the write."""
    layout = schemas.VECTORS[kind]
    if dim is not None:
        wrong = F.raise_error(F.concat(F.lit(f"expected {dim} numbers, found "), F.size("vector"), F.lit(" in "), "source_id"))
        checked = F.when(F.col("vector").isNull() | (F.size("vector") == dim), F.col("vector")).otherwise(wrong)
        vectors = vectors.withColumn("vector", checked)
    return schemas.align(vectors, layout, {"enterprise_name": "", "room_no": ""})


# -- sinks ------------------------------------------------------------------------

def _writer(df: DataFrame, mode: str, partition_by: str | None):
    writer = df.write.mode(mode)
    return writer.partitionBy(partition_by) if partition_by else writer


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    _writer(df, "append", partition_by).parquet(path)


def replace(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace-all write.  ``df`` must not read from ``path``, and a write that dies leaves a torn table;
    ``snapshots.publish`` has neither limit."""
    _writer(df, "overwrite", partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: str) -> None:
    """Replace only the partitions (tags, lists) that occur in ``df``."""
    _writer(df, "overwrite", partition_by).option("partitionOverwriteMode", "dynamic").parquet(path)


def store(df: DataFrame, name_or_path: str) -> None:
    """Replace-all write to a Parquet folder or a catalog table."""
    if "/" in name_or_path:
        replace(df, name_or_path)
    else:
        replace_table(df, name_or_path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share: below ``spark.checkpoint.dir``, or below the
    warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows stored in a work folder, new or given by its path, and read back, so that they are computed once."""
    path = name if "/" in name else work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a work folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: each write's go as it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def append_table(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(table)


def replace_table(df: DataFrame, table: str) -> None:
    df.write.mode("overwrite").saveAsTable(table)
