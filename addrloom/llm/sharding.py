"""Contiguous shards of nearly equal bytes, by global prefix sums.

1. Rows are range-partitioned by id; only the ids, sizes and the columns asked for travel.
2. One total per partition, and a running sum over these few totals.
3. Inside each partition a running sum from the partition's start gives every row its place
   in the whole table; equal cuts of that place are the shards.

No task holds more than one range partition. Rows with equal ids are ordered by checksum, size and a
running number, so a partition can be cut inside a group of repeated rows too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from addrloom.llm.shared import crc32, stored

ROW_OVERHEAD = 16


def shard_rows(
    documents: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """Every row with its ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 inside the shard).

    Returns the id, ``size`` (UTF-8 bytes of the text and 16 more), ``text_crc32`` (unsigned), ``shard``,
    ``slot`` and the columns in ``carry``.

    A null text has size 16 and no checksum; an empty text has size 16 and checksum 0.  Null ids come
    first.  Repeated rows each get a place of their own.  A row larger than a shard's target makes the
    shards it spans empty but for its own.  An empty table gives no rows.  Other columns are not read;
    ``carry`` may not name result columns.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    taken = {id_column, "size", "text_crc32", "shard", "slot"} & set(carry)
    if taken:
        raise ValueError(f"cannot carry {sorted(taken)}: names of result columns")
    text = F.col(f"`{text_column}`")
    rows = documents.select(
        F.struct(
            F.col(f"`{id_column}`").alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
            crc32(text).alias("crc"),
            F.monotonically_increasing_id().alias("number"),
        ).alias("k"),
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("rest"),
    )
    order = [F.col(f"k.{c}") for c in ("id", "crc", "size", "number")]
    ranged = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shard-ranges")

    # one row per partition from here to the join
    totals = ranged.groupBy("part").agg(F.sum("k.size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("part_bytes"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("part_rows"),
        F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("all_bytes"),
    )

    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumns({
            "begin": F.sum("k.size").over(inside) - F.col("k.size"),
            "nth": F.row_number().over(inside) - 1,
        })
        .join(F.broadcast(starts), "part")
        .withColumn("shard", F.expr(f"cast(((begin + part_bytes) * {shards}) div all_bytes as int)"))
        .withColumn("nth", F.col("nth") + F.col("part_rows"))
    )
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))  # at most one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("k.id").alias(id_column),
        F.col("k.size").alias("size"),
        F.col("k.crc").alias("text_crc32"),
        "shard",
        (F.col("nth") - F.col("first")).cast("long").alias("slot"),
        *[F.col(f"rest.`{c}`").alias(c) for c in carry],
    )


def write_shards(documents: DataFrame, path: str, shards: int, id_column: str = "doc_id", text_column: str = "text") -> None:
    """The documents as Parquet folders ``shard=N`` in slot order.

    Many tasks write one shard: a shard of any size is cut at the range partitions of (shard, slot).
    """
    carry = tuple(c for c in documents.columns if c not in {id_column, "size", "text_crc32", "shard", "slot"})
    rows = shard_rows(documents, shards, id_column, text_column, carry)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
