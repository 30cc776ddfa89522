"""Mentions of entities and relationships grouped into a graph per book and chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronokg.functions.text import relationship_id, weight
from chronokg.schemas import NO_DESCRIPTION, UNKNOWN

KEY = ["name", "book_number", "chapter"]


def named(entities: DataFrame) -> DataFrame:
    """Entity mentions with trimmed names, blank ones dropped."""
    return entities.withColumn("name", F.trim("name")).where("name <> ''")


def tied(edges: DataFrame) -> DataFrame:
    """Edge mentions with trimmed ends, blank ones dropped."""
    return edges.withColumn("source", F.trim("source")).withColumn("target", F.trim("target")).where("source <> '' and target <> ''")


def merged_description(raw):
    """Distinct descriptions in the order first seen."""
    return F.when(F.size(raw) > 0, F.array_join(F.array_distinct(raw), " | ")).otherwise(NO_DESCRIPTION)


def _listed(*values):
    """All values of a group's rows in the rows' order, gathered once."""
    return F.sort_array(F.collect_list(F.struct(F.col("ord").alias("o"), *[v.alias(f"v{i}") for i, v in enumerate(values)])))


def _of(rows: str, i: int):
    """The i-th value of gathered rows, without nulls."""
    return F.array_compact(F.transform(rows, lambda x: x[f"v{i}"]))


def _text(column: str):
    return F.when(F.trim(column) != "", F.trim(column))


def group_entities(mentions: DataFrame) -> DataFrame:
    """Mentions (name, book_number, chapter, type, description, unit_id, ord) by name, book and chapter; the first mention's type stays.

    ``ord`` is the mention's place in the whole scan and must be unique in a key.
    """
    grouped = named(mentions).groupBy(*KEY).agg(F.coalesce(F.min_by("type", "ord"), F.lit(UNKNOWN)).alias("type"), _listed(_text("description"), F.col("unit_id")).alias("_rows"))
    listed = grouped.select(*KEY, "type", _of("_rows", 0).alias("descriptions_raw"), _of("_rows", 1).alias("text_unit_ids"))
    return listed.withColumn("description", merged_description(F.col("descriptions_raw")))


def group_entities_first(mentions: DataFrame) -> DataFrame:
    """The variant that keeps the first mention's description alone."""
    return named(mentions).groupBy(*KEY).agg(F.coalesce(F.min_by("type", "ord"), F.lit(UNKNOWN)).alias("type"), F.min_by("description", "ord").alias("description"))


def first_seen(mentions: DataFrame) -> DataFrame:
    return named(mentions).groupBy(*KEY).agg(F.min("unit_ord").alias("first_seen"))


def _end(seen: DataFrame, column: str) -> DataFrame:
    return seen.select(F.col("name").alias(column), "book_number", "chapter", F.col("first_seen").alias(f"{column}_seen"))


def known_edges(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Edge mentions whose ends were both seen, in the same book and chapter, in the edge's unit or an earlier one (``unit_ord``)."""
    seen = first_seen(mentions)
    out = tied(edges)
    for end in ("source", "target"):
        out = out.join(_end(seen, end), [end, "book_number", "chapter"]).where(F.col(f"{end}_seen") <= F.col("unit_ord")).drop(f"{end}_seen")
    return out


def rejected_edges(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """The edge mentions that known_edges() leaves out."""
    out, seen = tied(edges), first_seen(mentions)
    for end in ("source", "target"):
        out = out.join(_end(seen, end), [end, "book_number", "chapter"], "left")
    late = lambda end: F.coalesce(F.col(f"{end}_seen") > F.col("unit_ord"), F.lit(True))
    return out.where(late("source") | late("target")).drop("source_seen", "target_seen")


def group_edges(edges: DataFrame) -> DataFrame:
    """Edge mentions (source, target, book_number, chapter, type, strength, description, unit_id, ord) by ends, book and chapter; type and weight are the first's."""
    ends = ["source", "target", "book_number", "chapter"]
    grouped = edges.groupBy(*ends).agg(
        F.coalesce(F.min_by("type", "ord"), F.lit(UNKNOWN)).alias("type"), weight(F.min_by("strength", "ord")).alias("weight"), _listed(_text("description"), F.col("unit_id")).alias("_rows"),
    )
    listed = grouped.select(*ends, "type", "weight", _of("_rows", 0).alias("descriptions_raw"), _of("_rows", 1).alias("text_unit_ids"))
    return listed.withColumn("description", merged_description(F.col("descriptions_raw"))).withColumn("id", relationship_id(*map(F.col, ends)))


def unit_links(mentions: DataFrame, key, out: str = "keys") -> DataFrame:
    """(unit_id, keys): the keys of a unit's mentions in their order, each as often as it is mentioned."""
    return mentions.groupBy("unit_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("ord").alias("o"), key.alias("k")))), lambda x: x["k"]).alias(out))
