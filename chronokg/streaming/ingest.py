"""Chunk rows as a stream into the mention tables, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronokg.functions.providers import Offline, Provider
from chronokg.plans.pipeline import extract

UNITS = "id string, text string, book_number int, global_chunk_index long, headings array<string>"


def ingest(spark: SparkSession, source: str, out: str, checkpoint: str, make: Callable[[], Provider] = Offline, files: int = 20) -> StreamingQuery:
    """New JSON-lines files of text units to ``out``/entity_mentions, edge_mentions and failed_units, ``files`` at a time.

    A batch is written under its number, so one that runs again after a failure
    overwrites its own rows and adds none.
    """

    def write(batch: DataFrame, number: int) -> None:
        for name, df in zip(("entity_mentions", "edge_mentions", "failed_units"), extract(batch, make)):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    units = spark.readStream.schema(UNITS).option("maxFilesPerTrigger", files).json(source)
    return units.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event type and tumbling window of a stream or table with ``ts``; later rows than ``late`` are dropped from a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
