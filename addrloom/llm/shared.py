"""What the operators share: stored intermediate tables, spread scans, text bounds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# one word: a run of anything but ASCII white space
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and every executor see: below
    ``spark.checkpoint.dir``, or below the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: a lost executor then
    costs a re-read, not the whole lineage, and nothing is computed twice."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_share(wanted: int, of: Column) -> Column:
    """A share of evenly spread hashes, from the lowest on, that holds the ``wanted`` lowest of ``of`` rows, all but
    surely: six standard deviations more are expected below it.  Cuts a sample's candidates where they are."""
    return (F.lit(wanted + 6 * wanted**0.5 + 50)) / F.greatest(of, F.lit(1))


def words(text: Column) -> Column:
    """The words of a text; none of a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def crc32(value: Column) -> Column:
    return F.crc32(value.cast("string").cast("binary"))
