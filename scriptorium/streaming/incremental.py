"""Streams that run to the end of what is there (``availableNow``) and go on from their checkpoint the next time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Snapshots, detect_changes, latest_by, upsert

DOCUMENT_KEY = ("source_id", "path")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and mean value per window and type; later than the watermark is dropped by a stream."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n_events"), F.sum("value").alias("total_value"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total_value")
    )


def run_to_end(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def index_documents(spark: SparkSession, source: str, schema, store: str, checkpoint: str) -> None:
    """Merge arriving document rows into the ``documents`` snapshots; unchanged content is not written again.

    Each batch is merged by key, so a batch that is replayed after a failure gives the same table.
    """
    snapshots = Snapshots(spark, store)

    def merge(batch: DataFrame, _number: int) -> None:
        arriving = latest_by(batch, DOCUMENT_KEY, ["updated_at", "doc_id"])
        stored = snapshots.read("documents")
        if stored is None:
            snapshots.write("documents", arriving)
            return
        changed = detect_changes(stored, arriving).where("change <> 'same'").drop("change")
        if not changed.isEmpty():
            snapshots.write("documents", upsert(stored, changed, DOCUMENT_KEY, ["title", "doc_type", "raw_content", "content_hash", "updated_at"]))

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
