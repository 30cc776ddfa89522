"""Building an index from chunk files, and asking it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronokg import schemas
from chronokg.functions import text as T
from chronokg.functions.providers import Offline, Provider, embedded, generated, reranked, scored
from chronokg.operators import graph, retrieve, vectors, windows
from chronokg.sources import store

UNIT_KEYS = ["unit_id", "unit_ord", "book_number", "chapter"]


def asked(units: DataFrame) -> DataFrame:
    """(unit keys, prompt) of text units."""
    prompt = F.concat(F.lit("EXTRACT entities and relationships as JSON.\nTEXT:\n"), "text")
    return units.select(F.col("id").alias("unit_id"), F.col("global_chunk_index").alias("unit_ord"), "book_number", T.chapter_of(F.col("headings")).alias("chapter"), prompt.alias("prompt"))


def mentions(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity mentions, edge mentions) of the model's replies. A malformed item is dropped alone."""
    parsed = replies.withColumn("r", T.parse_json(F.col("reply"), schemas.EXTRACTION))
    order = F.struct("unit_ord", "pos").alias("ord")
    entities = parsed.select(*UNIT_KEYS, F.posexplode("r.entities").alias("pos", "e")).where("e.name is not null")
    edges = parsed.select(*UNIT_KEYS, F.posexplode("r.relationships").alias("pos", "e")).where("e.source is not null and e.target is not null")
    return entities.select(*UNIT_KEYS, order, "e.*"), edges.select(*UNIT_KEYS, order, "e.*")


def answered(column: str = "reply"):
    return F.coalesce(F.length(column) > 0, F.lit(False))


def extract(units: DataFrame, make: Callable[[], Provider] = Offline) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entity mentions, edge mentions, failed units) of text units through the model."""
    replies = store.checkpointed(generated(asked(units), "prompt", make).drop("prompt"))
    return *mentions(replies), replies.where(~answered()).select(*UNIT_KEYS, "reply_error")


def progress(units: DataFrame, replies: DataFrame) -> DataFrame:
    """``units`` (id) with their state: done, again (every call so far failed) or new. ``replies``: unit_id, reply."""
    known = replies.groupBy(F.col("unit_id").alias("id")).agg(F.max(answered()).alias("_ok"))
    return units.join(known, "id", "left").withColumn("state", F.when(F.col("_ok"), "done").when(~F.col("_ok"), "again").otherwise("new")).drop("_ok")


def ask(spark: SparkSession, units: DataFrame, path: str, make: Callable[[], Provider] = Offline, every: int | None = None) -> tuple[DataFrame, int]:
    """(the replies, one to an answered unit; how many units were asked now).

    Replies are appended ``every`` units at a time (by default 20 for each core),
    so a run that breaks off loses that many at most. A later run asks only the
    units without an answer, those whose call failed before included.
    """
    every = every or schemas.CHECKPOINT_EVERY * spark.sparkContext.defaultParallelism
    kept = ["unit_id", "unit_ord", "book_number", "chapter", "reply", "reply_error"]
    todo = units
    if store.exists(spark, path):
        todo = progress(units, spark.read.parquet(path)).where("state <> 'done'").drop("state")
    batches = todo.groupBy(F.floor(F.col("global_chunk_index") / every).alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()
    for r in batches:
        own = todo.where(F.floor(F.col("global_chunk_index") / every) == r.b)
        generated(asked(own), "prompt", make).select(*kept).write.mode("append").parquet(path)
    if not store.exists(spark, path):
        generated(asked(units.limit(0)), "prompt", make).select(*kept).write.parquet(path)
    replies = spark.read.parquet(path).where(answered())
    return replies.dropDuplicates(["unit_id"]), sum(r.n for r in batches)


def build(spark: SparkSession, chunks_dir: str, out: str, size: int = 20, overlap: int = 5, make: Callable[[], Provider] = Offline, every: int | None = None) -> dict:
    """Chunk files to the four index tables in ``out``; the statistics.

    A stage that was written whole is read, not run again. Units whose call
    failed are asked again by the next run, and the stages after extraction run
    again if any unit was asked.
    """
    steps = f"{out}/intermediate"
    stale = False

    def stage(name: str, run: Callable[[], DataFrame]) -> DataFrame:
        if stale or not store.done(spark, steps, name):
            run().write.mode("overwrite").parquet(f"{steps}/{name}")
        return spark.read.parquet(f"{steps}/{name}")

    units = stage("units", lambda: store.read_chunks(spark, chunks_dir))
    replies, n_asked = ask(spark, units, f"{steps}/replies", make, every)
    stale = n_asked > 0
    said, tied = stage("entity_mentions", lambda: mentions(replies)[0]), stage("edge_mentions", lambda: mentions(replies)[1])
    known = stage("known_edges", lambda: graph.known_edges(tied, said))
    entities, edges = stage("entities", lambda: graph.group_entities(said)), stage("edges", lambda: graph.group_edges(known))

    key = T.entity_key(F.col("name"), F.col("book_number"), F.col("chapter"))
    named = graph.named(said).withColumn("entity", key)
    edge_id = T.relationship_id(F.col("source"), F.col("target"), F.col("book_number"), F.col("chapter"))
    marked = known.withColumn("edge", edge_id)
    held = windows.communities(units.withColumnRenamed("id", "unit_id"), named.select("unit_id", "entity").distinct(), size, overlap, marked.select("unit_id", "edge").distinct())
    prompts = report_prompts(held, named, marked, entities.withColumn("entity", key), edges)

    def reported() -> DataFrame:
        r = generated(prompts, "prompt", make).withColumn("r", T.parse_json(F.col("reply"), schemas.REPORT))
        span = F.concat("range_start", F.lit("-"), "range_end")
        counts = F.concat(F.lit("Сообщество содержит "), F.size("entities"), F.lit(" сущностей и "), F.size("relationships"), F.lit(" отношений."))
        return r.select(
            "id", "book_number", "window", F.coalesce("r.title", F.concat(F.lit("Окно "), span)).alias("title"),
            F.coalesce("r.summary", F.concat(F.lit("События в чанках "), span)).alias("summary"), F.coalesce("r.report", counts).alias("report"),
            F.col("range_start").alias("temporal_range_start"), F.col("range_end").alias("temporal_range_end"),
            F.col("position_start").alias("relative_position_start"), F.col("position_end").alias("relative_position_end"), "entities", "relationships", "text_unit_ids",
        )

    communities = stage("communities", reported)
    linked = units.join(graph.unit_links(named, F.col("entity"), "entities").withColumnRenamed("unit_id", "id"), "id", "left")
    linked = linked.join(graph.unit_links(marked, F.col("edge"), "relationships").withColumnRenamed("unit_id", "id"), "id", "left")
    none = F.array().cast("array<string>")
    linked = linked.withColumns({c: F.coalesce(c, none) for c in ("entities", "relationships")})
    tables = {
        "text_units": embedded(linked.withColumn("_t", F.coalesce("contextualized_text", "text")), "_t", make).drop("_t"),
        "entities": embedded(entities.withColumn("_t", F.concat("name", F.lit(": "), "description")), "_t", make).drop("_t"),
        "relationships": edges, "communities": embedded(communities, "report", make),
    }
    for name, df in tables.items():
        store.save(df, out, name)
    statistics = store.index_statistics({name: spark.read.parquet(f"{out}/data/{name}") for name in tables})
    answers = replies.count()
    statistics |= {"units_answered": answers, "units_failed": units.count() - answers}
    store.write_metadata(spark, out, statistics)
    return statistics


def report_prompts(held: DataFrame, named: DataFrame, marked: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """``held`` windows with the prompt for their reports: up to 50 entities and 50 relationships each, by first mention."""

    def listed(members: DataFrame, first: DataFrame, lines: DataFrame, out: str) -> DataFrame:
        told = windows.details(members, first).join(lines, "entity")
        rows = F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda e: e["line"])
        return told.groupBy("id").agg(F.array_join(rows, "\n").alias(out))

    seen = lambda df, column: df.groupBy(F.col(column).alias("entity")).agg(F.min("unit_ord").alias("first_chunk"))
    of = lambda column: held.select("id", F.explode(column).alias("entity"))
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit("): "), "description")
    tie = F.concat(F.lit("- "), "source", F.lit(" → "), "target", F.lit(": "), "description")
    ents = listed(of("entities"), seen(named, "entity"), entities.select("entity", line.alias("line")), "_entities")
    ties = listed(of("relationships"), seen(marked, "edge"), edges.select(F.col("id").alias("entity"), tie.alias("line")), "_relationships")
    nothing = F.lit("Нет данных")
    prompt = F.concat(
        F.lit("REPORT title, summary and report as JSON, book "), "book_number", F.lit(", chunks "), "range_start", F.lit("-"), "range_end",
        F.format_string(", positions %.2f-%.2f", "position_start", "position_end"), F.lit("\nTEXT:\nEntities\n"), F.coalesce("_entities", nothing), F.lit("\nRelationships\n"), F.coalesce("_relationships", nothing),
    )
    return held.join(ents, "id", "left").join(ties, "id", "left").withColumn("prompt", prompt).drop("_entities", "_relationships")


@dataclass
class Answer:
    query: str
    answer: str
    context: str
    entities: list = field(default_factory=list)
    communities: list = field(default_factory=list)
    edges: list = field(default_factory=list)
    sources: list = field(default_factory=list)
    prompt: str = ""
    books: list = field(default_factory=list)
    system: str = ""


SYSTEM = "Answer from the given context only. If it holds no answer, say so; quote sources exactly and add nothing else."


def _answer(query: str, context: str, make) -> tuple[str, str]:
    prompt = f"КОНТЕКСТ:\n{context}\n\nВОПРОС:\n{query}\n\nОТВЕТ:"
    try:
        return make().generate([prompt])[0], prompt
    except Exception as e:  # the error's text is the answer
        return f"Error: {e}", prompt


def select_entities(entities: DataFrame, query: str, books: list[int] | None, k: int, use_reranker: bool, make) -> DataFrame:
    """The k entities for a question: the nearest, oversampled, filtered by book and reranked; if the question can't be embedded, the first k of the index, whatever their book."""
    try:
        vector = make().embed([query])[0]
    except Exception:
        return entities.withColumn("d2", F.lit(None).cast("double")).orderBy("book_number", "chapter", "name").limit(k)
    near = vectors.knn(entities, vector, k * (3 if use_reranker else 2), "entity")
    near = near.where(F.col("book_number").isin(books)) if books else near
    if not use_reranker:
        return near.orderBy("d2", "entity").limit(k)
    return reranked(near, query, "doc", k, "entity", make, "d2").orderBy(F.desc("score"), "d2", "entity").drop("score")


def local_context(chosen: DataFrame, owned: DataFrame, budget: int) -> DataFrame:
    """(entity_idx, k, kind, text) of the entities and edges under one running budget, in order; k is 0 for the entity itself.

    ``chosen``: entity_idx, entity, name, type, description; ``owned``: entity,
    k from 1, text. Both have a question's few rows.
    """
    text = retrieve.entity_text(F.col("name"), F.col("type"), F.col("description"))
    lines = owned.groupBy("entity").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("lines"))
    none = F.array().cast("array<string>")
    rows = chosen.join(lines, "entity", "left").select("entity_idx", "name", text.alias("text"), F.coalesce("lines", none).alias("lines"))
    cost = F.struct(
        T.tokens(F.col("text")).alias("cost"), T.tokens(retrieve.edge_header(F.col("name"))).alias("header"), F.transform("lines", lambda x: T.tokens(x)).alias("edges"), F.col("text"), F.col("name"), F.col("lines"), F.col("entity_idx")
    )
    items = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("entity_idx", cost.alias("c")))).alias("i")).select(F.lit(0).alias("query_id"), F.transform("i", lambda x: x["c"]).alias("items"))
    left = budget - len("# Entities\n\n") // 4
    taken = retrieve.stateful_budget(items.select("query_id", F.transform("items", lambda c: F.struct(c["cost"].alias("cost"), c["header"].alias("header"), c["edges"].alias("edges"))).alias("items")), left)
    met = items.join(taken, "query_id").select(F.explode(F.arrays_zip("items", "taken")).alias("z")).where("z.taken is not null").select("z.items.*", "z.taken")
    own = met.select("entity_idx", F.lit(0).alias("k"), F.lit("entity").alias("kind"), "text")
    head = met.where(F.size("lines") > 0).select("entity_idx", F.lit(0).alias("k"), F.lit("header").alias("kind"), retrieve.edge_header(F.col("name")).alias("text"))
    edges = met.select("entity_idx", F.posexplode(F.slice("lines", F.lit(1), F.col("taken"))).alias("k", "text")).select("entity_idx", (F.col("k") + 1).alias("k"), F.lit("edge").alias("kind"), "text")
    return own.unionByName(head).unionByName(edges)


def search(spark: SparkSession, base: str, query: str, books: list[int] | None = None, top_k: int = 5, top_k_entities: int = 10, use_reranker: bool = True, make: Callable[[], Provider] = Offline) -> Answer:
    """Entities near the question, their communities, edges and sources, in a context under the budget."""
    index = store.load_index(spark, base)
    if books is None:
        books = spark.range(1).select(T.book_hints(F.lit(query)).alias("b")).first().b
    key = T.entity_key(F.col("name"), F.col("book_number"), F.col("chapter"))
    entities = index["entities"].withColumn("entity", key).withColumn("doc", F.concat("name", F.lit(": "), "description"))
    n_units = F.size("text_unit_ids").alias("n_units")
    ranked = select_entities(entities, query, books, top_k_entities, use_reranker, make)
    chosen = ranked.select("entity", "name", "type", "description", "book_number", "chapter", n_units, "d2").collect()  # k rows
    if not chosen:
        answer, prompt = _answer(query, "", make)
        return Answer(query, answer, "", prompt=prompt, books=books or [], system=SYSTEM)
    fields = "entity string, entity_idx int, name string, type string, description string"
    few = spark.createDataFrame([(r.entity, i, r.name, r.type, r.description) for i, r in enumerate(chosen)], fields)
    groups = spark.read.parquet(f"{base}/data/communities")
    best = retrieve.overlap_top_k(groups, few, top_k, books)
    order = [F.desc("overlap"), "book_number", "window"]
    reports = best.join(groups.drop("book_number", "window"), "id").withColumn("text", F.concat(F.lit("## "), "title", F.lit("\n"), "summary", F.lit("\n")))
    budget = int(schemas.CONTEXT_TOKENS * schemas.COMMUNITY_SHARE)
    told = retrieve.prefix_budget(retrieve.with_tokens(reports).withColumn("g", F.lit(0)), budget, ["g"], order, header=len("# Community Reports\n") // 4).orderBy(*order).drop("embedding").collect()

    ends = lambda end: T.entity_key(F.col(end), F.col("book_number"), F.col("chapter"))
    first = index["text_units"].select(F.col("id").alias("_first"), F.col("relative_position").alias("_at"))
    ties = index["relationships"].withColumn("source_key", ends("source")).withColumn("target_key", ends("target")).withColumn("_first", F.get("text_unit_ids", 0))
    owned = retrieve.edges_of(ties, few).join(first, "_first", "left")
    # A first unit that the index doesn't hold is placed by the number in its id.
    owned = owned.withColumn("position", F.coalesce("_at", T.chunk_number(F.col("_first")), F.lit(999.0)))
    owned = owned.withColumn("k", F.row_number().over(retrieve.edge_order())).where(F.col("k") <= schemas.TOP_EDGES)
    owned = store.checkpointed(owned.withColumn("text", retrieve.edge_text(F.col("source"), F.col("target"), F.col("description"))).drop("_first", "_at"))
    lines = owned.select("entity", "k", "id", "text", "source", "target", "type", "description", "weight", "book_number", "chapter", "in_net", n_units).orderBy("entity", "k").collect()
    local_budget = int(schemas.CONTEXT_TOKENS * (1 - schemas.COMMUNITY_SHARE - schemas.SOURCE_SHARE))
    kinds = F.when(F.col("kind") == "entity", 0).when(F.col("kind") == "header", 1).otherwise(2)
    local = [r.text for r in local_context(few, owned, local_budget).orderBy("entity_idx", kinds, "k").collect()]

    listed = index["entities"].withColumn("entity", key).join(few.select("entity", "entity_idx"), "entity")
    claims = retrieve.first_claims(listed.select("entity", "entity_idx", "text_unit_ids"))
    claims = claims.join(few.select("entity", F.col("name").alias("_name"), F.col("description").alias("_description")), "entity")
    claims = claims.join(index["text_units"].withColumnRenamed("id", "unit_id").drop("entities", "relationships", "embedding"), "unit_id")
    context_query = F.concat(F.lit(f"{query}. Контекст: "), "_name", F.lit(": "), T.truncated(F.col("_description"), 200))
    judged = scored(claims.withColumn("_q", context_query).withColumn("_d", T.truncated(F.col("text"), 1000)).drop("_name", "_description"), "_q", "_d", make).drop("_q", "_d").where("score is not null")
    source_budget = int(schemas.CONTEXT_TOKENS * schemas.SOURCE_SHARE)
    told_source = judged.withColumn("line", retrieve.source_text(F.col("unit_id"), F.col("text")))
    # Every source costs a token or more, so no more than the budget's number can be taken.
    best_sources = retrieve.with_tokens(told_source, "line").orderBy(F.desc("score"), "unit_id").limit(source_budget).withColumn("g", F.lit(0))
    kept = retrieve.prefix_budget(best_sources, source_budget, ["g"], [F.desc("score"), "unit_id"], header=len("# Sources\n\n") // 4)
    columns = ["unit_id", "entity", "book_number", "book_title", T.chapter_of(F.col("headings")).alias("chapter"), "chunk_index", "relative_position", "text_tokens", "text", "line"]
    cited = retrieve.chronological(kept).select(*columns).collect()
    parts = []
    if told:
        parts += ["# Community Reports\n", *(r.text for r in told)]
    parts += ["# Entities\n", *local]
    if cited:
        parts += ["# Sources\n", *(r.line for r in cited)]
    context = "\n".join(p.rstrip("\n") + "\n" if p.endswith("\n\n") else p for p in parts)
    answer, prompt = _answer(query, context, make)
    rows = lambda found: [r.asDict() for r in found]
    return Answer(query, answer, context, rows(chosen), rows(told), rows(lines), rows(cited), prompt, books or [], SYSTEM)


def classic_search(spark: SparkSession, base: str, query: str, top_k_search: int = 50, top_k_rerank: int = 5, use_reranker: bool = True, make: Callable[[], Provider] = Offline) -> Answer:
    """Chunks nearest to the normalised question, reranked, as many as fit the budget."""
    raw = [float(x) for x in make().embed([query])[0]]
    vector = spark.range(1).select(vectors.normalized(F.array(*map(F.lit, raw))).alias("v")).first().v
    near = vectors.knn(store.load(spark, base, "text_units"), vector, top_k_search, "id").withColumnRenamed("d2", "distance")
    if use_reranker:
        ranked = reranked(near, query, "text", top_k_rerank, "id", make, "distance").orderBy(F.desc("score"), "distance", "id")
    else:
        ranked = near.withColumn("score", -F.col("distance")).orderBy("distance", "id").limit(top_k_rerank)
    order = Window.orderBy(F.desc("score"), "distance", "id")
    numbered = ranked.withColumn("n", F.row_number().over(order)).withColumn("chapter", F.coalesce(F.get("headings", 0), F.col("chunk_index").cast("string"))).withColumn("g", F.lit(0))
    kept = retrieve.prefix_budget(retrieve.with_tokens(numbered), schemas.CONTEXT_TOKENS, ["g"], ["n"])
    line = retrieve.chunk_text(F.col("n"), F.col("book_number"), F.col("chapter"), F.col("id"), F.col("text"))
    rows = kept.withColumn("line", line).orderBy("n").select("id", "n", "distance", "score", "book_number", "chapter", "chunk_index", "text", "line").collect()
    context = "\n\n".join(r.line for r in rows)
    answer, prompt = _answer(query, context, make)
    return Answer(query, answer, context, sources=[r.asDict() for r in rows], prompt=prompt, system=SYSTEM)
