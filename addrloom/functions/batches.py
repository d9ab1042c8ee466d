"""Size of the batches that Arrow functions get."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold ``BATCH_BYTES``, not Spark's 64 MB: a task has a worker for every Arrow function on its way,
    and each holds a batch of whole texts, and what it makes of it, several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
