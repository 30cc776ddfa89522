"""Count-based windows over each book's units, and what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronokg.schemas import DETAIL_CAP


def assign(units: DataFrame, size: int = 20, overlap: int = 5, index: str = "chunk_index") -> DataFrame:
    """``units`` once for each window that holds them, with the window's start. Windows start at every multiple of size - overlap; tails are short."""
    step = size - overlap
    if step == 0:
        raise ValueError("overlap equals size")
    if step < 0:
        return units.withColumn("start", F.lit(0)).limit(0)
    p = F.col(index)
    low = F.greatest(F.lit(0), F.ceil((p - size + 1) / step)).cast("int")
    return units.withColumn("start", F.explode(F.transform(F.sequence(low, F.floor(p / step).cast("int")), lambda k: k * step)))


def communities(units: DataFrame, links: DataFrame, size: int = 20, overlap: int = 5, edges: DataFrame | None = None) -> DataFrame:
    """Windows of units (book_number, chunk_index, relative_position, unit_id) with the entities of ``links`` (unit_id, entity).

    Windows without any entity go, and the rest are numbered from 0 in each
    book. A window has its units' ids in order and, with ``edges`` (unit_id,
    edge), its distinct relationships.
    """
    held = assign(units, size, overlap)
    keys = ["book_number", "start"]
    bounds = held.groupBy(*keys).agg(
        F.min("chunk_index").alias("range_start"), F.max("chunk_index").alias("range_end"), F.min("relative_position").alias("position_start"), F.max("relative_position").alias("position_end"),
        F.count("*").alias("n_units"), F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "unit_id"))), lambda x: x["unit_id"]).alias("text_unit_ids"),
    )
    members = held.join(links, "unit_id").groupBy(*keys).agg(F.sort_array(F.collect_set("entity")).alias("entities"))
    number = F.row_number().over(Window.partitionBy("book_number").orderBy("start")) - 1
    out = bounds.join(members, keys).withColumn("window", number).withColumn("id", F.concat(F.lit("book"), "book_number", F.lit("_window_"), "window"))
    if edges is None:
        return out
    ties = held.join(edges, "unit_id").groupBy(*keys).agg(F.sort_array(F.collect_set("edge")).alias("relationships"))
    return out.join(ties, keys, "left").withColumn("relationships", F.coalesce("relationships", F.array().cast("array<string>")))


def details(members: DataFrame, first: DataFrame, cap: int = DETAIL_CAP) -> DataFrame:
    """(id, entity, rank) of ``members``: each window's entities by first chunk, then name, ``cap`` at most; unknown ones go."""
    order = Window.partitionBy("id").orderBy("first_chunk", "entity")
    return members.join(first, "entity").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def chapter_instances(rolled: DataFrame, edges: DataFrame) -> DataFrame:
    """(book_number, chapter, entity, range_start, range_end, edges, strengths): an entity of a chapter with its edges there.

    ``rolled`` has the chapters' entities and relationships, ``edges`` (id,
    source, target, weight); a strength is ten times a weight, cut to a whole
    number. Entities without edges have none.
    """
    at = ["book_number", "chapter"]
    entities = rolled.select(*at, "range_start", "range_end", F.explode("entities").alias("entity"))
    held = rolled.select(*at, F.explode("relationships").alias("id")).join(edges.select("id", "source", "target", "weight"), "id")
    ends = held.select(*at, "id", "weight", F.explode(F.array_distinct(F.array("source", "target"))).alias("entity"))
    own = ends.groupBy(*at, "entity").agg(F.sort_array(F.collect_list(F.struct("id", F.floor(F.round(F.col("weight") * 10, 6)).cast("int").alias("s")))).alias("e"))
    none = F.array().cast("array<struct<id:string,s:int>>")
    return entities.join(own, [*at, "entity"], "left").withColumn("e", F.coalesce("e", none)).select(*at, "entity", "range_start", "range_end", F.col("e.id").alias("edges"), F.col("e.s").alias("strengths"))


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (id, other) of windows of one book whose closed ranges meet, id < other; ranges are met by blocks of chunks, each pair at the block where it starts."""
    width = 64
    block = lambda df, low, high: df.withColumn("block", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    a = block(left.select("id", "book_number", "range_start", "range_end"), "range_start", "range_end")
    b = block(right.select(F.col("id").alias("other"), "book_number", F.col("range_start").alias("s"), F.col("range_end").alias("e")), "s", "e")
    met = a.join(b, ["book_number", "block"]).where("range_start <= e and s <= range_end and id < other")
    return met.where(F.col("block") == F.floor(F.greatest("range_start", "s") / width)).select("id", "other", "book_number")


def contains(index):
    """Whether a window's closed range holds a chunk."""
    return F.lit(index).between(F.col("range_start"), F.col("range_end"))


def chapters(windows: DataFrame) -> DataFrame:
    """Windows (book_number, chapter, ranges, entities) rolled up by chapter."""
    from chronokg.sources.store import checkpointed

    at, windows = ["book_number", "chapter"], checkpointed(windows)  # read once for the ranges and once for each set
    ranges = windows.groupBy(*at).agg(F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end"), F.count("*").alias("n_windows"))
    for name in ("entities", "relationships"):
        if name in windows.columns:  # sets are made of single values, combined before the shuffle
            own = windows.select(*at, F.explode(name).alias("v")).groupBy(*at).agg(F.sort_array(F.collect_set("v")).alias(name))
            ranges = ranges.join(own, at, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return ranges
