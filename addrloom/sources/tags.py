"""Tags: named batches, each with a recall and a match table in the catalog.

The list of tags is a catalog table partitioned by prefix, so adding a tag is an
append and deleting one drops a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from addrloom import schemas
from addrloom.functions.prefixes import read_tag, tag_prefix, tag_tables
from addrloom.functions.text import strip
from addrloom.vocab import RECALL_SUFFIX

TAG_TABLE = "match_tags"


def _ensure(spark: SparkSession) -> None:
    if not spark.catalog.tableExists(TAG_TABLE):
        spark.createDataFrame([], schemas.TAGS).write.partitionBy("prefix").saveAsTable(TAG_TABLE)


def _ensure_empty(spark: SparkSession, table: str, layout) -> None:
    if not spark.catalog.tableExists(table):
        spark.createDataFrame([], layout).write.saveAsTable(table)


def create_tag(spark: SparkSession, name: str, readings=None) -> Row | None:
    """Create a tag and its empty tables; an existing prefix is returned as is,
    and a blank name creates nothing.  ``readings`` is a map column or a table
    (``char``, ``reading``) of any size."""
    _ensure(spark)
    if isinstance(readings, DataFrame):
        prefix = F.lit(read_tag(name, readings))
    else:
        prefix = tag_prefix(F.col("tag_name"), readings)
    row = (
        spark.range(1).select(strip(F.lit(name)).alias("tag_name"), F.current_timestamp().alias("created_at"))
        .withColumn("prefix", prefix)
        .withColumns(tag_tables(F.col("prefix")))
        .select("tag_name", "recall_table", "match_table", "created_at", "prefix")
    )
    wanted = row.first()
    existing = find_tag(spark, wanted["prefix"])
    if existing is not None:
        return existing
    if not wanted["tag_name"]:
        return None
    spark.createDataFrame([wanted], schemas.TAGS).write.mode("append").partitionBy("prefix").saveAsTable(TAG_TABLE)
    _ensure_empty(spark, wanted["recall_table"], schemas.RECALL)
    _ensure_empty(spark, wanted["match_table"], schemas.MATCH)
    return find_tag(spark, wanted["prefix"])


def all_tags(spark: SparkSession) -> DataFrame:
    _ensure(spark)
    return spark.table(TAG_TABLE).orderBy("created_at", "prefix")


def find_tag(spark: SparkSession, prefix: str) -> Row | None:
    _ensure(spark)
    return spark.table(TAG_TABLE).where(F.col("prefix") == prefix).first()


def delete_tag(spark: SparkSession, prefix: str) -> bool:
    """Drop a tag with both its tables; False if there is none."""
    tag = find_tag(spark, prefix)
    if tag is None:
        return False
    spark.sql(f"DROP TABLE IF EXISTS `{tag['recall_table']}`")
    spark.sql(f"DROP TABLE IF EXISTS `{tag['match_table']}`")
    spark.sql(f"ALTER TABLE {TAG_TABLE} DROP IF EXISTS PARTITION (prefix = '{prefix}')")
    return True


def prefixes_in_catalog(spark: SparkSession) -> list[str]:
    """Prefixes found by the names of the recall tables in the catalog."""
    names = [t.name for t in spark.catalog.listTables() if t.name.endswith(RECALL_SUFFIX)]
    return sorted(n[: -len(RECALL_SUFFIX)] for n in names if n[: -len(RECALL_SUFFIX)])
