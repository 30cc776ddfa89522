"""From a parsed document's elements to chunks under a token budget."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from chronokg.functions.text import collapse, quarter, sentences, tokens


def keep_element(label: Column, page: Column, text: Column, last_page: int = 5) -> Column:
    """False for entries of a table of contents, which stands on the first pages."""
    low = F.lower(F.trim(text))
    entry = (label == "list_item") & (page <= last_page) & low.startswith("глава") & (F.length(F.trim(text)) <= 12) & (F.size(F.split(collapse(text), " ")) <= 2)
    return ~F.coalesce(entry, F.lit(False))


def table_heading(cells: Column) -> Column:
    """True for tables that are chapter headings."""
    return (F.size(cells) <= 3) & F.array_join(cells, " ").rlike(r"(?i)(?U)^\s*глава\s+\d+")


def resolve(reference: Column, collection: str, items: Column) -> Column:
    """The element that ``#/collection/index`` names; null if it is malformed or out of range."""
    index = F.regexp_extract(reference, rf"^#/{collection}/(\d+)$", 1)
    return F.when(index != "", F.get(items, index.cast("int")))


def valid_heading(text: Column) -> Column:
    return text.startswith("Глава ") | text.startswith("Часть ") | text.startswith("Эпилог") | text.startswith("Пролог") | (text == "Annotation")


def _stacks(rows: pa.Array) -> pa.Array:
    """Of each document's headings in order: the stack that each leaves. A heading of level L cuts the stack to L - 1 entries and goes on top."""
    out = []
    for headings in rows.to_pylist():
        stack: list[str] = []
        done = []
        for h in headings:
            stack = [*stack[: max(1, h["level"]) - 1], h["text"]]
            done.append({"pos": h["pos"], "headings": stack})
        out.append(done)
    return pa.array(out, pa.list_(pa.struct([("pos", pa.int64()), ("headings", pa.list_(pa.string()))])))


def heading_stack(elements: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """``elements`` (label, level, text) with the headings above each, itself included.

    Only headings, a few of a document's elements, are gathered; their stacks
    are carried on to the elements that follow. Levels of any depth count; a
    null one is 1.
    """
    mine = F.col("label").contains("header") & (F.col("label") != "page_header") & valid_heading(F.trim("text"))
    heads = elements.where(mine).groupBy(doc).agg(
        F.sort_array(F.collect_list(F.struct(F.col(pos).cast("long").alias("pos"), F.coalesce("level", F.lit(1)).cast("int").alias("level"), F.trim("text").alias("text")))).alias("h")
    )
    fold = arrow_udf(_stacks, "array<struct<pos:bigint,headings:array<string>>>")
    stacks = heads.select(doc, F.explode(fold("h")).alias("s")).select(doc, F.col("s.pos").alias(pos), F.col("s.headings").alias("_own"))
    past = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    carried = F.coalesce(F.last("_own", ignorenulls=True).over(past), F.array().cast("array<string>"))
    return elements.join(stacks, [doc, pos], "left").withColumn("headings", carried).drop("_own")


def merge_fragments(elements: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Join elements whose text doesn't end a sentence with those after, unless a header follows; (doc, pos, n_parts, text).

    Where ``elements`` has them, a merged element has the first one's page and
    the last headings that aren't empty.
    """
    order = Window.partitionBy(doc).orderBy(pos)
    before, label = F.lag(F.rtrim("text")).over(order), F.col("label")
    starts = before.isNull() | before.rlike("[.!?…]$") | label.contains("header")
    parts = elements.withColumn("_part", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.aggregate(
        F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("text").alias("t")))), F.lit(""),
        lambda a, x: F.when(a == "", x["t"]).when(a.endswith(" ") | a.endswith("-"), F.concat(a, x["t"])).otherwise(F.concat(a, F.lit(" "), x["t"])),
    )
    more = []
    if "page" in elements.columns:
        more.append(F.min_by("page", pos).alias("page"))
    if "headings" in elements.columns:
        last = F.max(F.when(F.size("headings") > 0, F.struct(F.col(pos).alias("p"), "headings")))
        more.append(F.coalesce(last["headings"], F.array().cast("array<string>")).alias("headings"))
    return parts.groupBy(doc, "_part").agg(F.min(pos).alias(pos), F.count("*").alias("n_parts"), joined.alias("text"), *more).drop("_part")


def packed(items: list[str], most: int, count: Callable[[str], int] = quarter, glue: str = " ", words: bool = True) -> list[str]:
    """Items joined greedily while they stay within ``most`` tokens; one over it ends the open chunk and is split by words, and a single word over it is a chunk."""
    out: list[str] = []
    held = ""
    for item in items:
        if count(item) > most:
            out += [held] if held else []
            held = ""
            out += packed([w for w in item.split(" ") if w], most, count, words=False) if words else [item]
        elif held and count(whole := f"{held}{glue}{item}") <= most:
            held = whole
        else:
            out += [held] if held else []
            held = item
    return out + ([held] if held else [])


def pack_words(sentence: Column, most: int, count: Callable[[str], int] = quarter) -> Column:
    """A long sentence in word groups within the budget; a single word over it is a group."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([packed([w for w in (v or "").split(" ") if w], most, count, words=False) for v in x.to_pylist()], pa.list_(pa.string()))

    return arrow_udf(run, "array<string>")(sentence)


def pack_sentences(items: Column, most: int, count: Callable[[str], int] = quarter, glue: str = " ") -> Column:
    """Sentences in chunks within the budget, in one pass over each array."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([packed(v or [], most, count, glue) for v in x.to_pylist()], pa.list_(pa.string()))

    return arrow_udf(run, "array<string>")(items)


def chunk_sections(sections: DataFrame, keys: list[str], most: int = 512, text: str = "text", count: Callable[[str], int] = quarter) -> DataFrame:
    """One row per chunk of each section: keys, chunk_index from 0, text and tokens."""
    held = sections.select(*keys, pack_sentences(sentences(F.col(text)), most, count).alias("_chunks"))
    return held.select(*keys, F.posexplode("_chunks").alias("chunk_index", "text")).withColumn("tokens", tokens(F.col("text"), count))


def _sections(elements: DataFrame, doc: str, pos: str, items: Column) -> DataFrame:
    """Runs of elements under the same headings, with their pages and all their items in order."""
    order = Window.partitionBy(doc).orderBy(pos)
    changed = (F.lag("headings").over(order).isNull() | (F.lag("headings").over(order) != F.col("headings"))).cast("int")
    numbered = elements.withColumn("_section", F.sum(changed).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(doc, "_section").agg(
        F.first("headings").alias("headings"), F.array_sort(F.array_distinct(F.collect_list("page"))).alias("page_numbers"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(pos, items.alias("items")))), lambda x: x["items"])).alias("items"),
    )


def _numbered(chunks: DataFrame, doc: str, count: Callable[[str], int]) -> DataFrame:
    """Chunks (doc, _section, _k, text, headings, page_numbers) with their ids and sizes."""
    number = F.row_number().over(Window.partitionBy(doc).orderBy("_section", "_k"))
    return chunks.select(
        doc, F.concat(F.lit("chunk_"), number).alias("chunk_id"), "text", tokens(F.col("text"), count).alias("tokens"), F.size(sentences(F.col("text"))).alias("sentence_count"), "page_numbers", "headings"
    )


def chunk_document(elements: DataFrame, most: int = 512, doc: str = "doc_id", pos: str = "pos", count: Callable[[str], int] = quarter) -> DataFrame:
    """Elements (doc, pos, label, level, text, page) to chunks: headings, fragments, then packing with a break wherever headings change."""
    stacked = heading_stack(elements.where(F.trim("text") != ""), doc, pos)
    merged = merge_fragments(stacked.select(doc, pos, "label", "text", "page", "headings"), doc, pos)
    held = _sections(merged, doc, pos, sentences(F.col("text"))).select(doc, "_section", "headings", "page_numbers", pack_sentences(F.col("items"), most, count).alias("_chunks"))
    return _numbered(held.select(doc, "_section", "headings", "page_numbers", F.posexplode("_chunks").alias("_k", "text")), doc, count)


def chunk_hybrid(elements: DataFrame, most: int = 512, merge_peers: bool = True, doc: str = "doc_id", pos: str = "pos", count: Callable[[str], int] = quarter) -> DataFrame:
    """Chunks along the document's own elements: one over the budget is split, and with ``merge_peers`` neighbours under the same headings are joined while they fit.

    ``contextualized_text`` has the headings above the text.
    """
    stacked = heading_stack(elements.where(F.trim("text") != ""), doc, pos).where(~F.col("label").contains("header"))
    item = F.when(tokens(F.col("text"), count) > most, pack_sentences(sentences(F.col("text")), most, count)).otherwise(F.array(F.trim("text")))
    held = _sections(stacked, doc, pos, item)
    chunks = pack_sentences(F.col("items"), most, count, "\n") if merge_peers else F.col("items")
    held = held.select(doc, "_section", "headings", "page_numbers", chunks.alias("_chunks"))
    out = _numbered(held.select(doc, "_section", "headings", "page_numbers", F.posexplode("_chunks").alias("_k", "text")), doc, count)
    return out.withColumn("contextualized_text", F.array_join(F.concat("headings", F.array("text")), "\n"))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.avg("tokens").alias("avg_tokens"), F.min("tokens").alias("min_tokens"), F.max("tokens").alias("max_tokens"))
