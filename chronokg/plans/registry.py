"""Every query over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronokg.functions import text as T
from chronokg.operators import chunking, graph, retrieve, vectors, windows
from chronokg.operators.positions import dense_index, in_book, relative_position
from chronokg.plans import fixtures as X
from chronokg.plans import pipeline
from chronokg.sources.store import unprocessed
from chronokg.streaming.ingest import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def joined(column):
    return F.array_join(column, ",")


# --- vectors -----------------------------------------------------------------------------------------------------
_D2 = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def _query_vector(spark, sf_dir, vec_id=0):
    return X.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


@query(f"""SELECT v.vec_id, v.label, round({_D2}, 6) AS d2, round(1 / (1 + {_D2}), 6) AS similarity FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_D2}, v.vec_id LIMIT 10""")
def knn_topk(spark, sf_dir):
    found = vectors.knn(X.table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10)
    return found.select("vec_id", "label", F.round("d2", 6).alias("d2"), F.round(vectors.similarity(F.col("d2")), 6).alias("similarity"))


def _queries(spark, sf_dir):
    return X.table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"""SELECT query_id, rank, vec_id, round(d2, 6) AS d2 FROM (SELECT q.vec_id AS query_id, v.vec_id, {_D2} AS d2, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D2}, v.vec_id) AS INTEGER) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 5""")
def knn_batch_topk(spark, sf_dir):
    return vectors.knn_batch(X.table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 5).withColumn("d2", F.round("d2", 6))


@query(f"""SELECT vec_id, label FROM (SELECT v.vec_id, v.label FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 1) q ORDER BY {_D2}, v.vec_id LIMIT 30) WHERE label IN (1, 2, 3)""")
def knn_oversample_postfilter(spark, sf_dir):
    near = vectors.knn(X.table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir, 1), 30)
    return retrieve.after_top_k(near.withColumnRenamed("label", "book_number"), [1, 2, 3], 30).select("vec_id", F.col("book_number").alias("label"))


_NORM = f"sqrt({_DOT.format(a='embedding', b='embedding')})"


@query(f"""WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3 / (3 * {_NORM})) AS embedding FROM embeddings WHERE vec_id = 2)
    SELECT CAST(row_number() OVER (ORDER BY {_D2}, v.vec_id) AS INTEGER) AS rank, v.vec_id, round({_D2}, 6) AS distance FROM embeddings v, q ORDER BY {_D2}, v.vec_id LIMIT 50""")
def knn_normalized_query(spark, sf_dir):
    raw = F.transform("embedding", lambda x: 3 * x.cast("double"))
    query = X.table(spark, sf_dir, "embeddings").where("vec_id = 2").select(vectors.normalized(raw).alias("q")).first().q
    near = vectors.knn(X.table(spark, sf_dir, "embeddings"), query, 50)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("d2", "vec_id"))).select("rank", "vec_id", F.round("d2", 6).alias("distance"))


@query(f"""SELECT a.vec_id AS left_id, b.vec_id AS right_id, round({_DOT.format(a='a.embedding', b='b.embedding')} / (sqrt({_DOT.format(a='a.embedding', b='a.embedding')}) * sqrt({_DOT.format(a='b.embedding', b='b.embedding')})), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf_dir):
    a = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("a"))
    b = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("b"))
    return a.join(b, F.col("right_id") == F.col("left_id") + 1).select("left_id", "right_id", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("""SELECT label, CAST(i AS INTEGER) AS place, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i""")
def mean_pool(spark, sf_dir):
    pooled = vectors.mean_pool(X.table(spark, sf_dir, "embeddings"), ["label"])
    return pooled.select("label", F.posexplode("embedding").alias("place", "mean")).withColumn("mean", F.round("mean", 6))


@query("SELECT vec_id, label, len(embedding) AS n FROM embeddings WHERE vec_id IN (3, 7, 999999)")
def vector_lookup(spark, sf_dir):
    return vectors.lookup(X.table(spark, sf_dir, "embeddings"), [3, 7, 999999]).select("vec_id", "label", F.size("embedding").cast("long").alias("n"))


# --- text --------------------------------------------------------------------------------------------------------
_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?…])\s+([А-ЯA-Z«\-\d])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda s: trim(s)), lambda s: s <> '')"""


@query(rf"""WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)""")
def sentence_split(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


_CHUNKS = rf"""RECURSIVE split AS (SELECT doc_id, {_SENTENCES} AS s FROM documents),
    sent AS (SELECT doc_id, i, s[i] AS t FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM split)),
    words AS (SELECT doc_id, i, t, list_filter(string_split(t, ' '), lambda w: w <> '') AS w FROM sent WHERE length(t) // 4 > 128),
    cut AS (SELECT doc_id, i, 1 AS k, 0 AS g, 0 AS held, false AS alone FROM words
        UNION ALL SELECT c.doc_id, c.i, c.k + 1, CASE WHEN c.k = 1 OR (NOT c.alone AND NOT n.over AND (c.held + 1 + n.l) // 4 <= 128) THEN c.g ELSE c.g + 1 END,
            CASE WHEN c.k > 1 AND NOT c.alone AND NOT n.over AND (c.held + 1 + n.l) // 4 <= 128 THEN c.held + 1 + n.l ELSE n.l END, n.over
        FROM cut c JOIN (SELECT doc_id, i, unnest(range(1, len(w) + 1)) AS k, length(unnest(w)) AS l, l // 4 > 128 AS over FROM words) n ON n.doc_id = c.doc_id AND n.i = c.i AND n.k = c.k),
    pieces AS (SELECT c.doc_id, c.i, c.g, string_agg(n.word, ' ' ORDER BY c.k) AS t FROM cut c JOIN (SELECT doc_id, i, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM words) n ON n.doc_id = c.doc_id AND n.i = c.i AND n.k = c.k - 1 GROUP BY ALL),
    item AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, g) AS j, t, length(t) AS l, alone FROM (SELECT doc_id, i, 0 AS g, t, false AS alone FROM sent WHERE length(t) // 4 <= 128 UNION ALL SELECT doc_id, i, g, t, true FROM pieces)),
    pack AS (SELECT doc_id, j, 0 AS g, l AS held, alone FROM item WHERE j = 1
        UNION ALL SELECT p.doc_id, n.j, CASE WHEN p.alone OR n.alone OR (p.held + 1 + n.l) // 4 > 128 THEN p.g + 1 ELSE p.g END,
            CASE WHEN p.alone OR n.alone OR (p.held + 1 + n.l) // 4 > 128 THEN n.l ELSE p.held + 1 + n.l END, n.alone
        FROM pack p JOIN item n ON n.doc_id = p.doc_id AND n.j = p.j + 1),
    chunks AS (SELECT doc_id, CAST(g AS INTEGER) AS chunk_index, string_agg(t, ' ' ORDER BY j) AS text FROM pack JOIN item USING (doc_id, j) GROUP BY doc_id, g)"""


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_index, text, CAST(length(text) // 4 AS INTEGER) AS tokens FROM chunks")
def greedy_chunks(spark, sf_dir):
    return chunking.chunk_sections(X.table(spark, sf_dir, "documents"), ["doc_id"], 128)


@query(f"WITH {_CHUNKS} SELECT count(*) AS n_chunks, round(avg(length(text) // 4), 6) AS avg_tokens, CAST(min(length(text) // 4) AS INTEGER) AS min_tokens, CAST(max(length(text) // 4) AS INTEGER) AS max_tokens FROM chunks")
def chunk_stats(spark, sf_dir):
    return chunking.chunk_statistics(chunking.chunk_sections(X.table(spark, sf_dir, "documents"), ["doc_id"], 128)).withColumn("avg_tokens", F.round("avg_tokens", 6))


@query("""WITH RECURSIVE w AS (SELECT item_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS w FROM benchmark),
    p AS (SELECT item_id, w, 1 AS i, 0 AS g, '' AS open FROM w
        UNION ALL SELECT item_id, w, i + 1, CASE WHEN open = '' THEN g WHEN length(w[i]) // 4 > 16 OR length(open || ' ' || w[i]) // 4 > 16 THEN g + 1 ELSE g END,
            CASE WHEN open = '' OR length(w[i]) // 4 > 16 OR length(open || ' ' || w[i]) // 4 > 16 THEN w[i] ELSE open || ' ' || w[i] END FROM p WHERE i <= len(w))
    SELECT item_id, CAST(g AS INTEGER) AS pos, max_by(open, i) AS words FROM p WHERE open <> '' GROUP BY item_id, g""")
def word_packing(spark, sf_dir):
    return X.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(chunking.pack_words(F.replace("text", F.lit("\n"), F.lit(" ")), 16)).alias("pos", "words"))


@query(r"""WITH e AS (SELECT conv_id, turn, text, CASE WHEN turn % 5 = 0 THEN 'section_header' ELSE 'text' END AS label, CASE WHEN turn % 2 = 0 THEN rtrim(text) ELSE rtrim(text, '.!?… ') END AS t FROM conversations),
    b AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM e),
    s AS (SELECT *, sum(CASE WHEN before IS NULL OR regexp_matches(before, '[.!?…]$') OR label LIKE '%header%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM b)
    SELECT conv_id, min(turn) AS pos, count(*) AS n_parts, string_agg(t || CASE WHEN turn = last OR t = '' OR regexp_matches(t, '[ -]$') THEN '' ELSE ' ' END, '' ORDER BY turn) AS joined
    FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id, part) AS last FROM s) GROUP BY conv_id, part""")
def fragment_merge(spark, sf_dir):
    turns = X.table(spark, sf_dir, "conversations")
    open_ended = F.when(F.col("turn") % 2 == 0, F.rtrim("text")).otherwise(F.rtrim("text", F.lit(".!?… ")))
    merged = chunking.merge_fragments(turns.select("conv_id", F.col("turn").alias("pos"), F.when(F.col("turn") % 5 == 0, "section_header").otherwise("text").alias("label"), open_ended.alias("text")), "conv_id")
    return merged.select("conv_id", "pos", "n_parts", F.col("text").alias("joined"))


@query("""SELECT item_id, CAST(length(text) // 4 AS INTEGER) AS tokens, CAST(greatest(1, ceil(length(text) / 80.0)) AS INTEGER) AS pieces,
    array_to_string(list_transform(range(0, greatest(1, CAST(ceil(length(text) / 80.0) AS BIGINT))), lambda k: substr(text, k * 80 + 1, 80)), chr(31)) AS all_pieces FROM benchmark""")
def token_pieces(spark, sf_dir):
    pieces = T.token_pieces(F.col("text"), 20)
    return X.table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("tokens"), F.size(pieces).alias("pieces"), F.array_join(pieces, "\x1f").alias("all_pieces"))


@query(r"""WITH f AS (SELECT lpad(CAST(o_orderkey % 97 AS VARCHAR), 2, '0') || '_' || replace(o_orderpriority, ' ', '_') || '_chunks.json' AS f, o_orderkey FROM orders)
    SELECT o_orderkey, CAST(regexp_extract(f, '^(\d+)', 1) AS INTEGER) AS book_number, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(f, '\.[^.]*$', ''), '^\d+[_\s-]*', ''), '[_-]', ' ', 'g'), '(?i)\s*chunks$', '')) AS book_title FROM f""")
def book_title_parse(spark, sf_dir):
    name = F.concat(F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"), F.lit("_"), F.replace("o_orderpriority", F.lit(" "), F.lit("_")), F.lit("_chunks.json"))
    return X.table(spark, sf_dir, "orders").select("o_orderkey", T.book_number(name).alias("book_number"), T.book_title(name).alias("book_title"))


_ASKED = [
    "Что случилось В ПЕРВОЙ КНИГЕ?", "Кто открыл тайная комната", "узник азкабана и кубок огня", "Кубок огня: кто победил?", "Орден Феникса", "принц-полукровка", "дары смерти в начале",
    "что было сначала", "Последняя битва", "как изменился герой на протяжении серии", "эволюция дружбы", "кто это такой?", "впервые в конце", "седьмая книга, вторая книга",
]


@query("""SELECT part_key, question, CASE WHEN regexp_matches(q, 'в первой книге|философский камень|первая книга') THEN '1' WHEN regexp_matches(q, 'во второй книге|тайная комната|вторая книга') THEN '2'
    WHEN regexp_matches(q, 'в третьей книге|узник азкабана|третья книга') THEN '3' WHEN regexp_matches(q, 'в четвертой книге|кубок огня|четвертая книга') THEN '4' WHEN regexp_matches(q, 'в пятой книге|орден феникса|пятая книга') THEN '5'
    WHEN regexp_matches(q, 'в шестой книге|принц-полукровка|шестая книга') THEN '6' WHEN regexp_matches(q, 'в седьмой книге|дары смерти|седьмая книга') THEN '7' WHEN regexp_matches(q, 'в начале|сначала|впервые') THEN '1,2'
    WHEN regexp_matches(q, 'в конце|финал|последн') THEN '6,7' WHEN regexp_matches(q, 'как изменился|эволюция|развитие|на протяжении') THEN '1,2,3,4,5,6,7' END AS books
    FROM (SELECT p_partkey AS part_key, (%s)[p_partkey %% %d + 1] AS question, lower(question) AS q FROM part)""" % (_ASKED, len(_ASKED)))
def book_hints(spark, sf_dir):
    asked = F.get(F.array(*map(F.lit, _ASKED)), (F.col("p_partkey") % len(_ASKED)).cast("int"))
    return X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), asked.alias("question")).withColumn("books", joined(T.book_hints(F.col("question")).cast("array<string>")))


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 5) AS k, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 5) / 10.0::DOUBLE AS weight, coalesce(json_extract_string(props, '$.none'), 'Unknown') AS chapter FROM events")
def json_extract_defaults(spark, sf_dir):
    p = T.parse_json(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), "k int, none string")
    return X.table(spark, sf_dir, "events").select("event_id", p.alias("p")).select("event_id", F.coalesce("p.k", F.lit(5)).alias("k"), T.weight(F.col("p.k")).alias("weight"), T.chapter_of(F.array("p.none")).alias("chapter"))


# --- positions ---------------------------------------------------------------------------------------------------
@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS chunk_index, round((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / CAST(greatest(count(*) OVER (PARTITION BY conv_id) - 1, 1) AS DOUBLE), 6) AS relative_position FROM conversations")
def relative_positions(spark, sf_dir):
    return in_book(X.table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", ["turn"]).withColumn("relative_position", F.round("relative_position", 6))


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS global_chunk_index FROM conversations")
def global_index(spark, sf_dir):
    return dense_index(X.table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])


# --- graph -------------------------------------------------------------------------------------------------------
_LINES = "l AS (SELECT *, CAST(year(o_orderdate) - 1994 AS INTEGER) AS book_number, 'Q' || quarter(o_orderdate) AS chapter FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_MENTIONS = f"""{_LINES}, m AS (SELECT book_number, chapter, l_orderkey AS unit_id, o_orderdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 0 AS side, 'part:' || l_partkey AS name, l_returnflag AS type, 'qty ' || CAST(floor(l_quantity) AS INTEGER) AS description FROM l
    UNION ALL SELECT book_number, chapter, l_orderkey, o_orderdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 1, 'supp:' || l_suppkey, l_linestatus, '' FROM l)"""
_ORD = "o_orderdate, unit_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, side"


@query(f"""WITH {_MENTIONS}, g AS (SELECT name, book_number, chapter, first(type ORDER BY {_ORD}) AS type, list(description ORDER BY {_ORD}) FILTER (description <> '') AS raw, string_agg(CAST(unit_id AS VARCHAR), ',' ORDER BY {_ORD}) AS text_unit_ids FROM m GROUP BY ALL)
    SELECT name, book_number, chapter, type, coalesce(array_to_string(raw, ','), '') AS descriptions_raw, text_unit_ids, CASE WHEN raw IS NULL THEN 'Нет описания' ELSE array_to_string(list_transform(list_filter(list_zip(raw, range(1, len(raw) + 1)), lambda x: list_position(raw, x[1]) = x[2]), lambda x: x[1]), ' | ') END AS description FROM g""")
def entity_grouping(spark, sf_dir):
    g = graph.group_entities(X.mentions(spark, sf_dir))
    return g.select("name", "book_number", "chapter", "type", joined("descriptions_raw").alias("descriptions_raw"), joined(F.col("text_unit_ids").cast("array<string>")).alias("text_unit_ids"), "description")


@query(f"""WITH {_MENTIONS} SELECT name, book_number, chapter, first(type ORDER BY {_ORD}) AS type, first(description ORDER BY {_ORD}) AS description FROM m GROUP BY ALL""")
def entity_grouping_first(spark, sf_dir):
    return graph.group_entities_first(X.mentions(spark, sf_dir))


_USERS = """e AS (SELECT event_id, user_id, event_type, CAST(weekofyear(ts) AS VARCHAR) AS chapter, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS u, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events),
    seen AS (SELECT event_type AS name, user_id, chapter, min(u) AS s FROM e GROUP BY ALL),
    j AS (SELECT e.*, a.s AS s1, b.s AS s2 FROM e LEFT JOIN seen a ON a.name = e.event_type AND a.user_id = e.user_id AND a.chapter = e.chapter LEFT JOIN seen b ON b.name = e.next_type AND b.user_id = e.user_id AND b.chapter = e.chapter WHERE next_type IS NOT NULL)"""


@query(f"""WITH {_USERS} SELECT event_type AS source, next_type AS target, user_id AS book_number, chapter, count(*) AS n, min(event_id) AS first_unit, md5(event_type || '|' || next_type || '|' || user_id || '|' || chapter) AS id FROM j WHERE s1 <= u AND s2 <= u GROUP BY ALL""")
def edge_grouping_asof(spark, sf_dir):
    entities, edges = X.user_mentions(spark, sf_dir)
    kept = graph.known_edges(edges, entities)
    g = kept.groupBy("source", "target", "book_number", "chapter").agg(F.count("*").alias("n"), F.min("unit_id").alias("first_unit"))
    return g.withColumn("id", T.relationship_id(F.col("source"), F.col("target"), F.col("book_number"), F.col("chapter")))


@query(f"WITH {_USERS} SELECT event_id AS unit_id, event_type AS source, next_type AS target FROM j WHERE coalesce(s1 > u, true) OR coalesce(s2 > u, true)")
def edge_rejected(spark, sf_dir):
    entities, edges = X.user_mentions(spark, sf_dir)
    return graph.rejected_edges(edges, entities).select("unit_id", "source", "target")


@query(f"""WITH {_LINES} SELECT 'part:' || l_partkey AS source, 'supp:' || l_suppkey AS target, book_number, chapter, first(l_returnflag ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS type, first(1 + CAST(floor(l_quantity) AS INTEGER) % 10 ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) / 10.0::DOUBLE AS weight,
    string_agg('qty ' || CAST(floor(l_quantity) AS INTEGER), ',' ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS descriptions_raw, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS text_unit_ids, md5('part:' || l_partkey || '|supp:' || l_suppkey || '|' || book_number || '|' || chapter) AS id FROM l GROUP BY l_partkey, l_suppkey, book_number, chapter""")
def edge_grouping(spark, sf_dir):
    g = graph.group_edges(graph.tied(X.edges(spark, sf_dir)))
    return g.select("source", "target", "book_number", "chapter", "type", "weight", joined("descriptions_raw").alias("descriptions_raw"), joined(F.col("text_unit_ids").cast("array<string>")).alias("text_unit_ids"), "id")


@query(f"""WITH {_MENTIONS} SELECT unit_id, string_agg(name || '|' || book_number || '|' || chapter, ',' ORDER BY {_ORD}) AS keys FROM m GROUP BY unit_id""")
def unit_backlinks(spark, sf_dir):
    key = T.entity_key(F.col("name"), F.col("book_number"), F.col("chapter"))
    return graph.unit_links(X.mentions(spark, sf_dir), key).withColumn("keys", joined("keys"))


@query("SELECT o_orderkey, md5(o_orderstatus || '|' || o_orderpriority) AS entity_id, o_orderstatus || '|' || year(o_orderdate) || '|' || o_orderpriority AS entity_key FROM orders")
def entity_ids(spark, sf_dir):
    return X.table(spark, sf_dir, "orders").select("o_orderkey", T.entity_id(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("entity_id"), T.entity_key(F.col("o_orderstatus"), F.year("o_orderdate"), F.col("o_orderpriority")).alias("entity_key"))


# --- windows -----------------------------------------------------------------------------------------------------
_UNITS = "u AS (SELECT o_orderkey AS unit_id, CAST(year(o_orderdate) - 1994 AS INTEGER) AS book_number, 'Q' || quarter(o_orderdate) AS chapter, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1 AS chunk_index, count(*) OVER (PARTITION BY year(o_orderdate)) AS n FROM orders)"
_WINDOWS = f"""{_UNITS}, links AS (SELECT DISTINCT l_orderkey AS unit_id, 'supp:' || l_suppkey AS entity FROM lineitem),
    held AS (SELECT u.*, s AS start FROM u, LATERAL (SELECT unnest(range(0, n, 15)) AS s) WHERE chunk_index >= s AND chunk_index < s + 20),
    bounds AS (SELECT book_number, start, min(chunk_index) AS range_start, max(chunk_index) AS range_end, min(chunk_index / greatest(n - 1, 1)) AS position_start, max(chunk_index / greatest(n - 1, 1)) AS position_end, count(*) AS n_units FROM held GROUP BY ALL),
    members AS (SELECT DISTINCT book_number, start, entity FROM held JOIN links USING (unit_id)),
    w AS (SELECT b.*, row_number() OVER (PARTITION BY book_number ORDER BY start) - 1 AS window_no, 'book' || book_number || '_window_' || window_no AS id FROM bounds b WHERE (book_number, start) IN (SELECT (book_number, start) FROM members))"""


def _communities(spark, sf_dir):
    line = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.concat(F.lit("supp:"), "l_suppkey").alias("entity"))
    return windows.communities(X.units(spark, sf_dir), line.distinct())


def _tied_communities(spark, sf_dir):
    """Communities with the relationships of their units; and those, a row per unit and edge."""
    e = X.edges(spark, sf_dir)
    edges = e.select("unit_id", T.relationship_id(F.col("source"), F.col("target"), F.col("book_number"), F.col("chapter")).alias("edge"), "source", "target").distinct()
    line = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.concat(F.lit("supp:"), "l_suppkey").alias("entity"))
    return windows.communities(X.units(spark, sf_dir), line.distinct(), edges=edges.select("unit_id", "edge")), edges


@query(f"""WITH {_WINDOWS} SELECT id, book_number, range_start, range_end, round(position_start, 6) AS position_start, round(position_end, 6) AS position_end, n_units, entities FROM w JOIN (SELECT book_number, start, string_agg(entity, ',' ORDER BY entity) AS entities FROM members GROUP BY ALL) USING (book_number, start)""")
def sliding_windows(spark, sf_dir):
    c = _communities(spark, sf_dir)
    return c.select("id", "book_number", F.col("range_start").cast("long").alias("range_start"), F.col("range_end").cast("long").alias("range_end"), F.round("position_start", 6).alias("position_start"), F.round("position_end", 6).alias("position_end"), "n_units", joined("entities").alias("entities"))


@query(f"""WITH {_WINDOWS}, f AS (SELECT 'supp:' || l_suppkey AS entity, min(l_orderkey) AS first_chunk FROM lineitem GROUP BY ALL), r AS (SELECT id, entity, first_chunk, CAST(row_number() OVER (PARTITION BY id ORDER BY first_chunk, entity) AS INTEGER) AS rank FROM w JOIN members USING (book_number, start) JOIN f USING (entity)) SELECT * FROM r WHERE rank <= 50""")
def window_details_top50(spark, sf_dir):
    first = X.table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("supp:"), "l_suppkey").alias("entity")).agg(F.min("l_orderkey").alias("first_chunk"))
    return windows.details(_communities(spark, sf_dir).select("id", F.explode("entities").alias("entity")), first).select("id", "entity", "first_chunk", "rank")


@query(f"""WITH {_WINDOWS}, {_LINES}, e AS (SELECT DISTINCT l_orderkey AS unit_id, md5('part:' || l_partkey || '|supp:' || l_suppkey || '|' || book_number || '|' || chapter) AS edge FROM l),
    r AS (SELECT book_number, start, count(DISTINCT edge) AS n_edges, md5(string_agg(DISTINCT edge, ',' ORDER BY edge)) AS edges_md5 FROM held JOIN e USING (unit_id) GROUP BY ALL),
    t AS (SELECT book_number, start, string_agg(CAST(unit_id AS VARCHAR), ',' ORDER BY chunk_index) AS text_unit_ids FROM held GROUP BY ALL)
    SELECT id, coalesce(n_edges, 0) AS n_edges, coalesce(edges_md5, md5('')) AS edges_md5, text_unit_ids FROM w JOIN t USING (book_number, start) LEFT JOIN r USING (book_number, start)""")
def window_relationships(spark, sf_dir):
    found, _ = _tied_communities(spark, sf_dir)
    return found.select("id", F.size("relationships").cast("long").alias("n_edges"), F.md5(joined("relationships")).alias("edges_md5"), joined(F.col("text_unit_ids").cast("array<string>")).alias("text_unit_ids"))


@query(f"""WITH {_WINDOWS}, {_LINES}, head AS (SELECT w.book_number, w.start, (SELECT any_value(u.chapter) FROM u WHERE u.book_number = w.book_number AND u.chunk_index = w.range_start) AS chapter FROM w),
    e AS (SELECT DISTINCT l_orderkey AS unit_id, md5('part:' || l_partkey || '|supp:' || l_suppkey || '|' || book_number || '|' || chapter) AS edge, 'supp:' || l_suppkey AS target FROM l),
    weights AS (SELECT md5('part:' || l_partkey || '|supp:' || l_suppkey || '|' || book_number || '|' || chapter) AS edge, first(1 + CAST(floor(l_quantity) AS INTEGER) % 10 ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS s FROM l GROUP BY 1),
    own AS (SELECT DISTINCT h.book_number, h.chapter, edge, target FROM head h JOIN held USING (book_number, start) JOIN e USING (unit_id)),
    ents AS (SELECT DISTINCT h.book_number, h.chapter, entity FROM head h JOIN members USING (book_number, start))
    SELECT n.book_number, n.chapter, entity, count(edge) AS n_edges, CAST(coalesce(sum(s), 0) AS BIGINT) AS strength FROM ents n LEFT JOIN own o ON o.book_number = n.book_number AND o.chapter = n.chapter AND o.target = n.entity LEFT JOIN weights USING (edge) GROUP BY ALL""")
def chapter_instances(spark, sf_dir):
    heads = X.units(spark, sf_dir).select("book_number", F.col("chunk_index").alias("range_start"), "chapter")
    found, _ = _tied_communities(spark, sf_dir)
    rolled = windows.chapters(found.join(heads, ["book_number", "range_start"]))
    held = windows.chapter_instances(rolled, graph.group_edges(X.edges(spark, sf_dir)))
    return held.select("book_number", "chapter", "entity", F.size("edges").cast("long").alias("n_edges"), F.aggregate("strengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("strength"))


#: The entities that a question selects, by how often they are mentioned.
_KEYS = "k AS (SELECT entity FROM (SELECT 'supp:' || l_suppkey AS entity, count(*) AS c FROM lineitem GROUP BY 1) ORDER BY c DESC, entity LIMIT 10)"


def _most_mentioned(spark, sf_dir, kind, column, k):
    named = X.table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit(kind), column).alias("entity")).agg(F.count("*").alias("c"))
    return named.orderBy(F.desc("c"), "entity").limit(k).select("entity")


def _keys(spark, sf_dir):
    return _most_mentioned(spark, sf_dir, "supp:", "l_suppkey", 10)


@query(f"""WITH {_WINDOWS}, {_KEYS} SELECT id, book_number, CAST(window_no AS INTEGER) AS "window", count(*) AS overlap FROM w JOIN members USING (book_number, start) JOIN k USING (entity) WHERE book_number IN (1, 2, 3) GROUP BY ALL ORDER BY overlap DESC, book_number, "window" LIMIT 5""")
def community_overlap_topk(spark, sf_dir):
    return retrieve.overlap_top_k(_communities(spark, sf_dir), _keys(spark, sf_dir), 5, [1, 2, 3])


@query(f"""WITH {_WINDOWS} SELECT a.id, b.id AS other, a.book_number FROM w a JOIN w b ON a.book_number = b.book_number AND a.range_start <= b.range_end AND b.range_start <= a.range_end AND a.id < b.id""")
def community_interval_overlap(spark, sf_dir):
    c = _communities(spark, sf_dir)
    return windows.overlapping(c, c)


@query(f"WITH {_WINDOWS} SELECT id FROM w WHERE 17 BETWEEN range_start AND range_end")
def community_contains_chunk(spark, sf_dir):
    return _communities(spark, sf_dir).where(windows.contains(17)).select("id")


@query(f"""WITH {_WINDOWS} SELECT book_number, chapter, min(range_start) AS range_start, max(range_end) AS range_end, count(DISTINCT start) AS n_windows, string_agg(DISTINCT entity, ',' ORDER BY entity) AS entities
    FROM (SELECT w.book_number, w.start, w.range_start, w.range_end, (SELECT any_value(u.chapter) FROM u WHERE u.book_number = w.book_number AND u.chunk_index = w.range_start) AS chapter FROM w) JOIN members USING (book_number, start) GROUP BY book_number, chapter""")
def chapter_rollup(spark, sf_dir):
    heads = X.units(spark, sf_dir).select("book_number", F.col("chunk_index").alias("range_start"), "chapter")
    rolled = windows.chapters(_communities(spark, sf_dir).join(heads, ["book_number", "range_start"]))
    return rolled.withColumn("entities", joined("entities")).withColumn("range_start", F.col("range_start").cast("long")).withColumn("range_end", F.col("range_end").cast("long"))


# --- retrieval ---------------------------------------------------------------------------------------------------
_EDGES = f"{_LINES}, ed AS (SELECT md5('part:' || l_partkey || '|supp:' || l_suppkey || '|' || book_number || '|' || chapter) AS id, 'part:' || l_partkey AS source_key, 'supp:' || l_suppkey AS target_key, min(l_orderkey) AS position FROM l GROUP BY l_partkey, l_suppkey, book_number, chapter)"
_BOTH = "k AS (SELECT entity FROM (SELECT 'supp:' || l_suppkey AS entity, count(*) AS c FROM lineitem GROUP BY 1 ORDER BY c DESC, entity LIMIT 3) UNION ALL SELECT entity FROM (SELECT 'part:' || l_partkey AS entity, count(*) AS c FROM lineitem GROUP BY 1 ORDER BY c DESC, entity LIMIT 20))"


def _edges(spark, sf_dir):
    e = X.edges(spark, sf_dir).groupBy("source", "target", "book_number", "chapter").agg(F.min("unit_id").alias("position"))
    return e.select(T.relationship_id(F.col("source"), F.col("target"), F.col("book_number"), F.col("chapter")).alias("id"), F.col("source").alias("source_key"), F.col("target").alias("target_key"), "position")


def _both(spark, sf_dir):
    return _most_mentioned(spark, sf_dir, "supp:", "l_suppkey", 3).unionByName(_most_mentioned(spark, sf_dir, "part:", "l_partkey", 20))


@query(f"WITH {_EDGES}, {_BOTH} SELECT id, source_key, target_key, position FROM ed WHERE source_key IN (SELECT entity FROM k) OR target_key IN (SELECT entity FROM k)")
def touching_edges(spark, sf_dir):
    return retrieve.touching(_edges(spark, sf_dir), _both(spark, sf_dir))


@query(f"""WITH {_EDGES}, {_BOTH}, o AS (SELECT k.entity, ed.id, source_key IN (SELECT entity FROM k) AND target_key IN (SELECT entity FROM k) AS in_net, position FROM ed JOIN k ON k.entity IN (source_key, target_key)),
    r AS (SELECT entity, id, in_net, CAST(row_number() OVER (PARTITION BY entity ORDER BY in_net DESC, position, id) AS INTEGER) AS rank FROM o) SELECT * FROM r WHERE rank <= 10""")
def edges_in_out_network(spark, sf_dir):
    owned = retrieve.edges_of(_edges(spark, sf_dir), _both(spark, sf_dir))
    return owned.withColumn("rank", F.row_number().over(retrieve.edge_order())).where("rank <= 10").select("entity", "id", "in_net", "rank")


@query("""WITH e AS (SELECT l_suppkey, l_orderkey AS unit_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS pos FROM lineitem),
    c AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY l_suppkey, pos) AS n FROM e) SELECT 'supp:' || l_suppkey AS entity, l_suppkey AS entity_idx, CAST(pos AS INTEGER) AS pos, unit_id FROM c WHERE n = 1""")
def unit_first_claim(spark, sf_dir):
    listed = X.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber"))), lambda x: x["l_orderkey"]).alias("text_unit_ids"))
    return retrieve.first_claims(listed.select(F.concat(F.lit("supp:"), "l_suppkey").alias("entity"), F.col("l_suppkey").alias("entity_idx"), "text_unit_ids")).select("entity", "entity_idx", "pos", "unit_id")


@query("""SELECT source, doc_id, tokens, running FROM (SELECT source, doc_id, CAST(length(text) // 4 AS INTEGER) AS tokens, CAST(sum(length(text) // 4) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) + 20 AS BIGINT) AS running FROM documents) WHERE running <= 6617""")
def prefix_budget(spark, sf_dir):
    docs = retrieve.with_tokens(X.table(spark, sf_dir, "documents").select("source", "doc_id", "text")).drop("text")
    return retrieve.prefix_budget(docs, 6617, ["source"], ["doc_id"], header=20)


@query("""WITH RECURSIVE item AS (SELECT l_suppkey AS query_id, l_orderkey % 50 AS cost, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS j, list(CAST(trunc(l_quantity) AS INTEGER) ORDER BY l_linenumber, l_quantity)[:10] AS edges FROM lineitem GROUP BY l_suppkey, l_orderkey),
    taken AS (SELECT query_id, 0::BIGINT AS j, 0::BIGINT AS total, []::BIGINT[] AS taken FROM (SELECT DISTINCT query_id FROM item)
        UNION ALL SELECT query_id, j, start + coalesce(list_sum(edges[:n]), 0), list_append(taken, n) FROM (
            SELECT t.query_id, i.j, t.taken, i.edges, t.total + i.cost + 3 AS start,
                coalesce(len(list_filter(range(1, len(i.edges) + 1), lambda k: t.total + i.cost + 3 + list_sum(i.edges[:k]) <= 300)), 0) AS n
            FROM taken t JOIN item i ON i.query_id = t.query_id AND i.j = t.j + 1 WHERE t.total + i.cost <= 300))
    SELECT query_id, CAST(max_by(total, j) AS INTEGER) AS total, array_to_string(max_by(taken, j), ',') AS taken FROM taken GROUP BY query_id""")
def stateful_budget(spark, sf_dir):
    line = X.table(spark, sf_dir, "lineitem")
    one = line.groupBy("l_suppkey", "l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))), lambda x: x["q"]).alias("edges"))
    item = lambda x: F.struct((x["l_orderkey"] % 50).cast("int").alias("cost"), F.lit(3).alias("header"), x["edges"].alias("edges"))
    items = one.groupBy(F.col("l_suppkey").alias("query_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "edges"))), item).alias("items"))
    return retrieve.stateful_budget(items, 300).select("query_id", "total", joined(F.col("taken").cast("array<string>")).alias("taken"))


@query(f"""WITH {_UNITS} SELECT unit_id, book_number, row_number() OVER (ORDER BY p, score DESC, unit_id) AS place FROM (SELECT unit_id, book_number, chunk_index / greatest(n - 1, 1) AS p, 1 / (1 + CAST(unit_id % 7 AS DOUBLE)) AS score FROM u)""")
def chronological_sources(spark, sf_dir):
    scored = X.units(spark, sf_dir).withColumn("score", 1 / (1 + F.col("unit_id") % 7)).withColumn("worse", -F.col("score"))
    placed = dense_index(scored, ["relative_position", "worse", "unit_id"], "place").withColumn("place", F.col("place") + 1)
    return retrieve.chronological(placed).select("unit_id", "book_number", "place")


@query("""WITH t AS (SELECT source, doc_id, '**Source ' || doc_id || '**:' || chr(10) || CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END || chr(10) || chr(10) AS line FROM documents),
    r AS (SELECT *, sum(length(line) // 4) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) + 2 AS running FROM t)
    SELECT source, string_agg(line, '' ORDER BY doc_id) AS context FROM r WHERE running <= 6617 GROUP BY source""")
def context_string(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").select("source", "doc_id", retrieve.source_text(F.col("doc_id").cast("string"), F.col("text")).alias("line"))
    kept = retrieve.prefix_budget(retrieve.with_tokens(docs, "line"), 6617, ["source"], ["doc_id"], header=2)
    return kept.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"]), "").alias("context"))


# --- recovery, statistics, events --------------------------------------------------------------------------------
@query("SELECT count(*) AS total, count(embedding) AS with_embeddings, max(len(embedding)) AS embedding_dim, count(*) FILTER (label = 0) AS label_0 FROM embeddings")
def index_stats(spark, sf_dir):
    has = F.size("embedding") > 0
    return X.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("total"), F.count_if(has).alias("with_embeddings"), F.max(F.size("embedding")).cast("long").alias("embedding_dim"), F.count_if(F.col("label") == 0).alias("label_0"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return unprocessed(X.table(spark, sf_dir, "documents").select("doc_id"), X.table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT event_id, CASE WHEN ok THEN 'done' WHEN tried THEN 'again' ELSE 'new' END AS state FROM
    (SELECT e.event_id, coalesce(bool_or(r.event_type <> 'error' AND r.value >= 10), false) AS ok, count(r.event_id) > 0 AS tried FROM events e LEFT JOIN (SELECT * FROM events WHERE value >= 5) r USING (event_id) GROUP BY e.event_id)""")
def resume_failed(spark, sf_dir):
    """Units that a run has answered, those whose call failed and are asked again, and those never asked."""
    events = X.table(spark, sf_dir, "events")
    replies = events.where("value >= 5").select(F.col("event_id").alias("unit_id"), F.when((F.col("event_type") != "error") & (F.col("value") >= 10), "ok").alias("reply"))
    return pipeline.progress(events.select(F.col("event_id").alias("id")), replies).select(F.col("id").alias("event_id"), "state")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    counted = windowed_counts(X.table(spark, sf_dir, "events"))
    return counted.select(F.col("window.start").alias("hour"), "event_type", "n", F.round("value", 4).alias("value"))
