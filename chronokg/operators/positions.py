"""Ordinal positions of text units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def relative_position(index, n):
    return index / F.greatest(n - 1, F.lit(1))


def in_book(units: DataFrame, book: str, order: list[str]) -> DataFrame:
    """``units`` with chunk_index from 0 in each book and relative_position in [0, 1]; ``order`` must be unique in a book."""
    own = Window.partitionBy(book)
    index = F.row_number().over(own.orderBy(*order)) - 1
    return units.withColumn("chunk_index", index).withColumn("relative_position", relative_position(F.col("chunk_index"), F.count("*").over(own)))


def dense_index(df: DataFrame, order: list[str], out: str = "global_chunk_index") -> DataFrame:
    """``df`` with a dense index from 0 in the given order, without one task for all rows.

    Rows are range-partitioned and sorted; each range's count is summed before
    it. The ranges are written once, to a checkpoint, as a second run could cut
    them elsewhere. What is broadcast is a row per range.
    """
    from chronokg.sources.store import checkpointed

    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place)
    held = checkpointed(ranged).withColumn("_range", F.shiftright("_at", 33))
    counts = held.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    return held.join(F.broadcast(starts), "_range").withColumn(out, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_range", "_start", "_at")
