"""The first rows by a running number, without sorting all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def first_by_number(rows: DataFrame, number: Column, count: int, block: int = BLOCK) -> DataFrame:
    """The ``count`` rows with the smallest ``number`` (whole and not negative; null numbers are left out).

    Rows are counted by blocks of numbers; blocks whose running sum stays within ``count`` are taken as they lie, and only
    the block that crosses it is sorted.  So no task sees more than a block, and the driver holds a count per block.  Of
    rows with one number that do not all fit, any may be taken.  ``rows`` are read twice: store them if they are costly.
    """
    # the rows stay inside one column, so none of their names can clash
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    placed = rows.select(row, number.alias("number"), F.floor(number / block).alias("block")).where("number is not null")
    left, cut = count, -1
    for r in placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).orderBy("block").collect():
        cut = r["block"]
        if r["n"] >= left:
            break
        left -= r["n"]
    whole = placed.where(F.col("block") < cut).select("row")
    order = Window.partitionBy("block").orderBy("number")
    last = placed.where(F.col("block") == cut).withColumn("place", F.row_number().over(order)).where(F.col("place") <= left)
    return whole.unionByName(last.select("row")).select("row.*")
