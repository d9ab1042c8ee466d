"""Run log kept as a table: ``id, level, message, created_at``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrloom import schemas

# fixed values: levels stored in the table (warning and above)
STORED_LEVELS = ("WARNING", "ERROR", "CRITICAL")


def stored(records: DataFrame) -> DataFrame:
    return schemas.align(records, schemas.LOG).where(F.col("level").isin(*STORED_LEVELS))


def append(records: DataFrame, path: str) -> None:
    stored(records).write.mode("append").parquet(path)


def latest(log: DataFrame, limit: int = 200, level: str | None = None) -> DataFrame:
    """Newest first, optionally of one level."""
    rows = log.where(F.col("level") == level) if level else log
    return rows.orderBy(F.desc("id")).limit(limit).select("id", "level", "message", "created_at")
