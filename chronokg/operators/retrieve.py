"""From near entities to communities, edges, sources and a context under a token budget.

The frames that one question selects (``keys``: entity keys in order of rank)
have a row per selected entity, so they are small by the caller's k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronokg.functions.text import preview, tokens
from chronokg.schemas import TOP_EDGES

ENTITY_FIELDS = "entity_idx int, ord int, kind string, text string"


def after_top_k(ranked: DataFrame, books: list[int] | None, k: int) -> DataFrame:
    """A book filter that comes after an oversampled top-k, so that fewer than k rows may be left; no books, no filter."""
    kept = ranked.where(F.col("book_number").isin(books)) if books else ranked
    return kept.limit(k)


def overlap_top_k(communities: DataFrame, keys: DataFrame, k: int, books: list[int] | None = None) -> DataFrame:
    """Communities by how many distinct ``keys`` (entity) they hold, ties by book and window."""
    kept = communities.where(F.col("book_number").isin(books)) if books else communities
    held = kept.select("id", "book_number", "window", F.explode(F.array_distinct("entities")).alias("entity")).join(keys.select("entity").distinct(), "entity", "left_semi")
    return held.groupBy("id", "book_number", "window").agg(F.count("*").alias("overlap")).orderBy(F.desc("overlap"), "book_number", "window").limit(k)


def touching(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges with an end among ``keys``, each once: a union of equi semi-joins, not a join on OR."""
    k = keys.select("entity").distinct()
    by_source = edges.join(k, edges["source_key"] == k["entity"], "left_semi")
    rest = edges.join(k, edges["source_key"] == k["entity"], "left_anti")
    return by_source.unionByName(rest.join(k, rest["target_key"] == k["entity"], "left_semi"))


def edges_of(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges by selected entity (a self-loop once), with in_net: both ends are selected."""
    k = keys.select("entity").distinct()
    ends = edges.withColumn("entity", F.explode(F.array_distinct(F.array("source_key", "target_key")))).join(k, "entity")
    other = F.when(F.col("entity") == F.col("source_key"), F.col("target_key")).otherwise(F.col("source_key"))
    marked = k.select(F.col("entity").alias("_other"), F.lit(True).alias("_in"))
    return ends.withColumn("_other", other).join(marked, "_other", "left").withColumn("in_net", F.coalesce("_in", F.lit(False))).drop("_other", "_in")


def edge_order(partition: str = "entity", position: str = "position", tie: str = "id") -> Window:
    """Edges inside the selected set first, then by position (unknown last)."""
    return Window.partitionBy(partition).orderBy(F.desc("in_net"), F.asc_nulls_last(position), tie)


def first_claims(entities: DataFrame) -> DataFrame:
    """(unit_id, entity, entity_idx, pos): each unit of ``entities`` (entity, entity_idx, text_unit_ids) goes to the best ranked entity that lists it."""
    listed = entities.select("entity", "entity_idx", F.posexplode("text_unit_ids").alias("pos", "unit_id"))
    order = Window.partitionBy("unit_id").orderBy("entity_idx", "pos")
    return listed.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def prefix_budget(items: DataFrame, budget: int | Column, keys: list[str], order: list, cost: str = "tokens", header: int = 0) -> DataFrame:
    """The longest prefix of each group whose costs, with the header's, stay within the budget."""
    running = F.sum(cost).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("running", running + header).where(F.col("running") <= budget)


def stateful_budget(entities: DataFrame, budget: int, most_edges: int = TOP_EDGES) -> DataFrame:
    """Entities and their edges under one running total.

    ``entities``: query_id, items array<struct<cost:int,header:int,edges:array<int>>>
    in order of rank. An entity over the budget ends everything; an edge over it
    ends that entity's edges; an edge header is charged unchecked. Gives query_id,
    total and the counts of edges taken per entity taken.
    """
    state = F.struct(F.lit(0).alias("total"), F.lit(False).alias("over"), F.array().cast("array<int>").alias("taken"))

    def entity(a, e):
        start = F.struct((a["total"] + e["cost"] + F.when(F.size(e["edges"]) > 0, e["header"]).otherwise(0)).alias("total"), F.lit(False).alias("over"), F.lit(0).alias("n"))
        ended = lambda s, c: s["over"] | (s["total"] + c > budget)
        done = F.aggregate(
            F.slice(e["edges"], 1, most_edges), start,
            lambda s, c: F.struct(F.when(ended(s, c), s["total"]).otherwise(s["total"] + c).alias("total"), ended(s, c).alias("over"), F.when(ended(s, c), s["n"]).otherwise(s["n"] + 1).alias("n")),
        )
        stop = a["over"] | (a["total"] + e["cost"] > budget)
        return F.struct(F.when(stop, a["total"]).otherwise(done["total"]).alias("total"), stop.alias("over"), F.when(stop, a["taken"]).otherwise(F.array_append(a["taken"], done["n"])).alias("taken"))

    return entities.select("query_id", F.aggregate("items", state, entity).alias("s")).select("query_id", F.col("s.total").alias("total"), F.col("s.taken").alias("taken"))


def chronological(sources: DataFrame, by_book: bool = False) -> DataFrame:
    """Sources by relative position, then score; with ``by_book`` books stay apart."""
    return sources.orderBy(*["book_number"] * by_book, "relative_position", F.desc("score"), "unit_id")


def entity_text(name, kind, description) -> Column:
    return F.concat(F.lit("**"), name, F.lit("** ("), kind, F.lit(")\n- "), description, F.lit("\n\n"))


def edge_text(source, target, description) -> Column:
    return F.concat(F.lit("- **"), source, F.lit("** → **"), target, F.lit("**: "), description, F.lit("\n"))


def edge_header(name) -> Column:
    return F.concat(F.lit("### Relationships для "), name, F.lit(":\n\n"))


def source_text(unit_id, text, most: int = 2000) -> Column:
    return F.concat(F.lit("**Source "), unit_id, F.lit("**:\n"), preview(text, most), F.lit("\n\n"))


def chunk_text(place, book, chapter, unit_id, text) -> Column:
    """A chunk of the plain search's context with its number, book, chapter and id."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(F.lit("[Документ "), place, F.lit("] (Книга "), known(book), F.lit(", Глава "), known(chapter), F.lit(", ID: "), unit_id, F.lit(")\n"), text)


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("tokens", tokens(F.col(text)))
