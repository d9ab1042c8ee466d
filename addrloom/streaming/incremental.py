"""Arriving address files, processed as Structured Streaming micro-batches.

Checkpoints live under ``spark.checkpoint.dir`` unless a folder is given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from addrloom import schemas
from addrloom.plans.tagging import tag_addresses
from addrloom.plans.vectorize import centres_path, encode, extend, vectorize_new
from addrloom.operators.pending import unvectorized
from addrloom.sources import snapshots, tables


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a shared folder, or give a checkpoint folder")
    return f"{base.rstrip('/')}/{name}"


def arriving(
    spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Parquet files landing in ``path``, optionally of a name ``pattern`` only."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def tag_stream(
    rows: DataFrame, address_column: str, target: str, mode: str = "17", id_column: str | None = None,
    tagger=None, checkpoint: str | None = None,
) -> StreamingQuery:
    """Tag every row once and append to ``target``.  Tagging is row by row, so
    the stream has no state; the file sink commits each batch exactly once."""
    tagged = tables.tagged_rows(tag_addresses(rows, address_column, mode, id_column, tagger), mode)
    return (
        tagged.writeStream.format("parquet").outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint or checkpoint_folder(rows.sparkSession, "tag_stream"))
        .trigger(availableNow=True)
        .start()
    )


def vectorize_stream(
    addresses: DataFrame, target: str, kind: str, encoder=None, checkpoint: str | None = None
) -> StreamingQuery:
    """Encode the ids not stored yet and append them.  A batch that is repeated after a failure adds nothing twice.

    ``target`` is a table that ``vectorize.publish`` made, plain or as an index, of which a batch reads only the cells its ids fall
    in; or a Parquet folder, also one stored as an index (new rows then go to the folder of their list), of which every
    batch reads all ids.  A folder that is not there yet is made.
    """
    spark = addresses.sparkSession
    layout = schemas.VECTORS[kind]
    state = checkpoint or checkpoint_folder(spark, "vectorize_stream")
    published = snapshots.is_snapshots(spark, target)
    indexed = not published and tables.exists(spark, centres_path(target))
    if not published and not indexed:
        # an empty table first, so that every batch finds one
        spark.createDataFrame([], layout).write.mode("append").parquet(target)
    name = hashlib.sha256(state.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        if published:
            extend(batch, target, kind, encoder, f"stream-{name}-{number}")
        elif indexed:
            vectorize_new(batch, target, kind, encoder)
        else:
            stored = batch.sparkSession.read.schema(layout).parquet(target)
            tables.append(tables.vector_rows(encode(unvectorized(batch, stored), kind, encoder), kind), target)

    return addresses.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def progress(query: StreamingQuery, total: int | None = None) -> dict[str, Any]:
    """Rows done, rows per second and, with a known total, share and seconds left."""
    done = sum(p["numInputRows"] for p in query.recentProgress)
    rate = float(query.lastProgress["processedRowsPerSecond"]) if query.lastProgress else 0.0
    out: dict[str, Any] = {"processed": done, "rate": rate}
    if total is not None:
        out |= {
            "total": total,
            "progress": done / total if total else 0.0,
            "remaining_seconds": (total - done) / rate if rate else 0.0,
        }
    return out


def on_progress(spark: SparkSession, report: Callable[[dict[str, Any]], None]):
    """Call ``report`` after every micro-batch of the session's queries."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:
            pass

        def onQueryProgress(self, event) -> None:
            p = event.progress
            report({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rate": p.processedRowsPerSecond})

        def onQueryIdle(self, event) -> None:
            pass

        def onQueryTerminated(self, event) -> None:
            pass

    listener = Listener()
    spark.streams.addListener(listener)
    return listener
