import datetime
import decimal
import glob
import json
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from chronokg.functions import providers
from chronokg.functions import text as T
from chronokg.operators import chunking, graph, retrieve, vectors, windows
from chronokg.operators.positions import in_book
from chronokg.plans import pipeline, registry, report
from chronokg.sources import store
from chronokg.streaming.ingest import ingest


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return int(v) if isinstance(v, decimal.Decimal) else str(v.replace(tzinfo=None)) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_parity_with_sql(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    found = duck.execute(registry.ORACLE_SQL[name])
    names, columns = [d[0] for d in found.description], sorted(df.columns)
    assert sorted(names) == columns
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == want


def pack(items, most, split):
    done, held = [], ""
    for s in items:
        if len(s) // 4 > most:
            done += [held] * bool(held) + split(s)
            held = ""
        elif len(joined := f"{held} {s}" if held else s) // 4 <= most:
            held = joined
        else:
            done, held = done + [held] * bool(held), s
    return done + [held] * bool(held)


def test_packing_against_a_model(spark):
    rng = random.Random(3)
    rows = [(i, [" ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 12))]) for i in range(80)] + [(99, ["y" * 300, "a b", "z" * 90 + " q"])]
    df = spark.createDataFrame(rows, "i int, s array<string>")
    got = {r.i: r.c for r in df.select("i", chunking.pack_sentences(F.col("s"), 16).alias("c")).collect()}
    for i, s in rows:
        assert got[i] == pack(s, 16, lambda x: pack(x.split(), 16, lambda w: [w]))


def test_windows_against_range(spark):
    for n in (1, 5, 19, 20, 21, 35, 36, 50):
        units = in_book(spark.range(n).select("id", F.lit(1).alias("book")), "book", ["id"])
        got = {}
        for r in windows.assign(units).collect():
            got.setdefault(r.start, []).append(r.chunk_index)
        assert {s: sorted(v) for s, v in got.items()} == {s: list(range(s, min(n, s + 20))) for s in range(0, n, 15)}
        assert windows.assign(units, 5, 6).count() == 0
    with pytest.raises(ValueError):
        windows.assign(units, 5, 5)


def test_empty_windows_are_skipped_and_numbers_dense(spark):
    units = in_book(spark.range(60).select(F.col("id").alias("unit_id"), F.lit(1).alias("book_number")), "book_number", ["unit_id"])
    links = spark.createDataFrame([(0, "a"), (59, "b"), (59, "b")], "unit_id long, entity string")
    got = windows.communities(units, links).orderBy("window").collect()
    assert [(r.id, r.range_start, r.entities) for r in got] == [("book1_window_0", 0, ["a"]), ("book1_window_1", 45, ["b"])]


def mention(name, unit, ord, type=None, description=None, chapter="c"):
    return Row(name=name, book_number=1, chapter=chapter, type=type, description=description, unit_id=f"u{unit}", unit_ord=unit, ord=ord)


def test_graph_edge_cases(spark):
    schema = "name string, book_number int, chapter string, type string, description string, unit_id string, unit_ord int, ord int"
    said = spark.createDataFrame([mention(" a ", 1, 0, "PERSON", "x"), mention("a", 1, 1, "EVENT", " "), mention("a", 2, 2, None, "y"), mention("a", 3, 3, None, "x"), mention("", 1, 4), mention("b", 2, 5), mention("d", 1, 6, chapter="other")], schema)
    got = {r.name: r for r in graph.group_entities(said).collect()}
    assert got["a"].type == "PERSON" and got["a"].descriptions_raw == ["x", "y", "x"] and got["a"].description == "x | y" and got["a"].text_unit_ids == ["u1", "u1", "u2", "u3"]
    assert got["b"].type == "UNKNOWN" and got["b"].description == "Нет описания" and "" not in got
    tied = spark.createDataFrame([("a", "b", 1, 1, None), ("a", "b", 2, 2, 7), ("a", "d", 3, 3, 5), ("a", " ", 3, 4, 5), ("b", "a", 2, 5, 3)], "source string, target string, unit_ord int, ord int, strength int").withColumns({"book_number": F.lit(1), "chapter": F.lit("c"), "type": F.lit("FACTUAL"), "description": F.lit(""), "unit_id": F.concat(F.lit("u"), "unit_ord")})
    kept = {(r.source, r.target): r for r in graph.group_edges(graph.known_edges(tied, said)).collect()}
    assert set(kept) == {("a", "b"), ("b", "a")} and kept["a", "b"].weight == 0.7 and kept["a", "b"].text_unit_ids == ["u2"]
    assert graph.rejected_edges(tied, said).count() == 2


def stateful(items, budget, most=10):
    total, taken = 0, []
    for cost, header, edges in items:
        if total + cost > budget:
            break
        total += cost + (header if edges else 0)
        n = 0
        for e in edges[:most]:
            if total + e > budget:
                break
            total, n = total + e, n + 1
        taken.append(n)
    return total, taken


def test_stateful_budget_against_a_model(spark):
    rng = random.Random(7)
    rows = [(i, [(rng.randint(0, 40), 3, [rng.randint(1, 30) for _ in range(rng.randint(0, 14))]) for _ in range(rng.randint(0, 10))]) for i in range(100)]
    df = spark.createDataFrame(rows, "query_id int, items array<struct<cost:int,header:int,edges:array<int>>>")
    got = {r.query_id: (r.total, r.taken) for r in retrieve.stateful_budget(df, 150).collect()}
    assert got == {i: stateful(items, 150) for i, items in rows}


def test_text_functions(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first().x

    lit = F.lit
    assert value(T.strip_fence(lit("```json\n{\"a\":1}\n```"))) == '{"a":1}' and value(T.strip_fence(lit("plain"))) == "plain"
    assert value(T.parse_json(lit(""), "a int")) is None and value(T.parse_json(lit("prose"), "a int")).a is None
    assert value(T.chunk_number(lit("book1_chunk_12"))) == 12.0 and value(T.chunk_number(lit("x"))) == 999.0
    assert value(T.book_hints(lit("Что в начале второй книги?"))) == [1, 2] and value(T.book_hints(lit("кто он"))) is None and value(T.book_hints(lit("в финале"))) == [6, 7]
    assert value(T.book_hints(lit("Кубок огня в конце"))) == [4] and value(T.book_hints(lit("Во второй книге, сначала"))) == [2]
    assert value(T.tokens(lit("a b c"), lambda s: len(s.split()))) == 3 and value(T.truncated(lit("abc"), 2)) == "ab"
    assert value(T.sentences(lit("Да. Нет! «Вот» 1… x.  "))) == ["Да.", "Нет!", "«Вот» 1… x."] and value(T.sentences(lit(None).cast("string"))) == []
    assert value(T.escape_markdown(lit("a|b\nc"))) == "a\\|b c" and value(T.percent(lit(0.5))) == "50.0%" and T.book_list("1, 2") == [1, 2]
    assert value(T.source_ids(lit("[book1_chunk_2] t book3_chunk_4"))) == ["book1_chunk_2", "book3_chunk_4"]
    assert value(vectors.cosine(F.array(lit(0.0)), F.array(lit(1.0)))) == 0.0
    assert not value(chunking.keep_element(lit("list_item"), lit(3), lit("Глава 12"))) and value(chunking.keep_element(lit("section_header"), lit(3), lit("Глава 12")))
    assert value(chunking.table_heading(F.array(lit("Глава"), lit("3")))) and value(chunking.resolve(lit("#/texts/1"), "texts", F.array(lit("a"), lit("b")))) == "b"


def test_providers(spark):
    class Broken(providers.Offline):
        def generate(self, prompts):
            raise OSError("down")

    df = spark.createDataFrame([("EXTRACT\nTEXT:\nAnna met Boris",)], "p string")
    assert providers.generated(df, "p").first().reply.startswith("{") and providers.generated(df, "p", Broken, tries=2, base=0.0).first().reply_error == "OSError: down"
    assert len(providers.embedded(df, "p").first().embedding) == 64 and providers.retry_delay(9, draw=lambda: 0.5) == 60.0
    calls = []
    with pytest.raises(ZeroDivisionError):
        providers.retried(lambda: calls.append(1) or 1 / 0, 3, sleep=lambda s: None)
    assert len(calls) == 3
    docs = spark.createDataFrame([("a", "red fox"), ("b", " "), ("c", "blue fox here")], "id string, doc string")
    assert [r.id for r in providers.reranked(docs, "blue fox", "doc", 5).orderBy(F.desc("score")).collect()] == ["c", "a"]


def test_build_and_search(spark, tmp_path):
    source = tmp_path / "chunks"
    source.mkdir()
    for book, names in ((1, ["Anna", "Boris"]), (2, ["Clara", "Anna"])):
        rows = [{"chunk_id": f"chunk_{i + 1}", "text": f"{names[i % 2]} met {names[(i + 1) % 2]} near the river.", "headings": [f"Глава {i // 10 + 1}"] if i else [], "tokens": 9} for i in range(25)]
        (source / f"{book:02d}_Some-Book_chunks.json").write_text(json.dumps(rows), encoding="utf-8")
    out = str(tmp_path / "index")
    statistics = pipeline.build(spark, str(source), out)
    assert statistics["total_text_units"] == 50 and statistics["embedding_dim"] == 64 and statistics["total_communities"] == 4
    assert pipeline.build(spark, str(source), out) == statistics
    index = store.load_index(spark, out)
    assert sorted(r.global_chunk_index for r in index["text_units"].collect()) == list(range(50)) and index["text_units"].first().book_title == "Some Book"
    found = pipeline.search(spark, out, "Who met Anna near the river?")
    assert found.entities and found.communities and found.sources and re.search("book[12]_chunk_", found.answer)
    assert all(e["book_number"] == 2 for e in pipeline.search(spark, out, "Anna во второй книге").entities)
    classic = pipeline.classic_search(spark, out, "Clara met Anna", use_reranker=False)
    assert len(classic.sources) == 5 and "[Документ 1]" in classic.context
    assert all(p.exists() for p in report.save(found, str(tmp_path / "r.md"))) and "Question" in report.summary(classic)
    with pytest.raises(Exception):
        (tmp_path / "none").mkdir()
        store.read_chunks(spark, str(tmp_path / "none"))


def test_documents_to_chunks(spark, tmp_path):
    texts = [("Глава 1", "section_header", 1, 1), ("Глава 2", "list_item", None, 2), ("First part that", "text", None, 6), ("goes on. Then ends.", "text", None, 7), ("Глава 2", "section_header", 1, 8), ("Second. More!", "text", None, 9), (" ", "text", None, 9)]
    doc = {"origin": {"filename": "x.pdf"}, "texts": [{"text": t, "label": l, "level": v, "prov": [{"page_no": p}]} for t, l, v, p in texts], "tables": []}
    (tmp_path / "d.json").write_text(json.dumps(doc), encoding="utf-8")
    chunks = chunking.chunk_document(store.elements(store.repaired(store.read_documents(spark, str(tmp_path / "d.json"))))).orderBy("chunk_id").collect()
    assert [(r.headings, r.text) for r in chunks] == [(["Глава 1"], "Глава 1 First part that goes on. Then ends."), (["Глава 2"], "Глава 2 Second. More!")]


def test_headings_are_cut_by_place(spark):
    rows = [("section_header", 2, "Глава 1"), ("text", None, "a"), ("section_header", 2, "Глава 2"), ("section_header", 7, "Глава 3"), ("text", None, "b"), ("page_header", 1, "Глава 9"), ("section_header", 1, " Часть 2"), ("text", None, "c"), ("section_header", None, "Форма")]
    df = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)] + [("e", 0, "text", None, "x")], "doc_id string, pos int, label string, level int, text string")
    got = {(r.doc_id, r.pos): r.headings for r in chunking.heading_stack(df).collect()}
    assert got["d", 1] == ["Глава 1"] and got["d", 2] == ["Глава 1", "Глава 2"] and got["d", 4] == got["d", 5] == ["Глава 1", "Глава 2", "Глава 3"]
    assert got["d", 7] == got["d", 8] == ["Часть 2"] and got["e", 0] == []


def test_fragments_keep_pages_and_headings(spark):
    rows = [(0, "text", "It goes", 1, ["A"]), (1, "text", "on.", 2, ["B"]), (2, "text", "And", 3, []), (3, "section_header", "Глава 1", 4, ["B"])]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc_id string, pos int, label string, text string, page int, headings array<string>")
    got = chunking.merge_fragments(df).orderBy("pos").collect()
    assert [(r.text, r.page, r.headings) for r in got] == [("It goes on.", 1, ["B"]), ("And", 3, []), ("Глава 1", 4, ["B"])]


def test_hybrid_chunks(spark):
    rows = [(0, "section_header", 1, "Глава 1", 1), (1, "text", None, "One two three.", 1), (2, "text", None, "Four five.", 2), (3, "text", None, "Six seven. Eight nine ten.", 3), (4, "section_header", 1, "Глава 2", 4), (5, "text", None, "End.", 4)]
    df = spark.createDataFrame([("d.json", *r) for r in rows], "doc_id string, pos int, label string, level int, text string, page int")
    words = lambda s: len(s.split())
    apart = chunking.chunk_hybrid(df, 4, False, count=words).orderBy("chunk_id").collect()
    assert [r.text for r in apart] == ["One two three.", "Four five.", "Six seven.", "Eight nine ten.", "End."]
    merged = chunking.chunk_hybrid(df, 5, count=words).orderBy("chunk_id").collect()
    assert [r.text for r in merged] == ["One two three.\nFour five.", "Six seven. Eight nine ten.", "End."] and merged[0].contextualized_text.startswith("Глава 1\nOne")


PARSED = {"origin": {"filename": "x.pdf"}, "texts": [{"text": t, "label": l, "level": 1, "prov": [{"page_no": p}]} for t, l, p in (("Глава 1", "section_header", 1), ("Глава 2", "list_item", 2), ("Anna met Boris.", "text", 6))], "tables": [{"label": "table", "data": {"table_cells": [{"text": "Глава"}, {"text": "2"}]}}]}
FAKE = f"""
import json

def parse(content):
    if content == b"bad":
        raise ValueError("no pages")
    return json.dumps({PARSED!r}) if content != b"odd" else "prose"
"""


def test_document_commands(spark, tmp_path, capsys):
    pdfs = tmp_path / "pdfs"
    pdfs.mkdir()
    for name, content in (("01_First.pdf", b"x"), ("02_Second.pdf", b"y"), ("03_Bad.pdf", b"bad"), ("04_Odd.pdf", b"odd")):
        (pdfs / name).write_bytes(content)
    (tmp_path / "fake_parser.py").write_text(FAKE, encoding="utf-8")
    spark.sparkContext.addPyFile(str(tmp_path / "fake_parser.py"))
    import chronokg.__main__ as shell

    options = ["--parsed-dir", str(tmp_path / "parsed"), "--chunks-dir", str(tmp_path / "chunks"), "--parser", "fake_parser:parse"]
    assert shell.main(["batch", str(pdfs), *options]) == 1
    said = capsys.readouterr()
    assert "2 of 4 files" in said.out and "03_Bad.pdf: ValueError: no pages" in said.err and "04_Odd.pdf" in said.err
    assert sorted(os.listdir(tmp_path / "parsed")) == ["01_First.json", "02_Second.json"]
    saved = json.loads((tmp_path / "parsed" / "01_First.json").read_text())
    assert [t["text"] for t in saved["texts"]] == ["Глава 1", "Anna met Boris."] and saved["tables"][0]["label"] == "section_header"
    units = store.read_chunks(spark, str(tmp_path / "chunks")).orderBy("global_chunk_index").collect()
    assert [(u.id, u.book_title, u.headings, u.text) for u in units] == [(f"book{n}_chunk_1", t, ["Глава 1"], "Глава 1 Anna met Boris.") for n, t in ((1, "First"), (2, "Second"))]
    assert shell.main(["parse", str(pdfs / "01_First.pdf"), str(tmp_path / "one"), "--no-filter-toc", "--parser", "fake_parser:parse"]) == 0
    assert len(json.loads((tmp_path / "one" / "01_First.json").read_text())["texts"]) == 3
    assert shell.main(["process", str(pdfs / "01_First.pdf"), *options, "--chunking-method", "hybrid"]) == 0
    assert shell.main(["chunk", str(tmp_path / "one"), str(tmp_path / "again"), "--max-tokens", "64"]) == 0
    with pytest.raises(ValueError):
        shell.main(["parse", str(pdfs / "01_First.pdf"), str(tmp_path / "one")])


def test_chunk_files_must_be_lists(spark, tmp_path):
    for body in ("{}", "prose", "[1, 2"):
        (tmp_path / "01_A_chunks.json").write_text(body)
        with pytest.raises(Exception, match="not a JSON list|01_A"):
            store.read_chunks(spark, str(tmp_path)).collect()


def test_build_asks_failed_units_again(spark, tmp_path):
    (tmp_path / "c").mkdir()
    rows = [{"text": f"{'Boris' if i == 3 else 'Anna'} met Clara."} for i in range(6)]
    (tmp_path / "c" / "01_B_chunks.json").write_text(json.dumps(rows))
    mended = str(tmp_path / "mended")

    class Flaky(providers.Offline):
        """Has no answer for units that name Boris while a file isn't there."""

        def generate(self, prompts):
            return [""] if "Boris" in prompts[0] and not os.path.exists(mended) else super().generate(prompts)

    make = Flaky
    out = str(tmp_path / "i")
    first = pipeline.build(spark, str(tmp_path / "c"), out, make=make, every=2)
    assert first["units_answered"] == 5 and first["units_failed"] == 1
    names = lambda: {r.name for r in store.load(spark, out, "entities").collect()}
    assert names() == {"Anna", "Clara"}
    open(mended, "w").close()
    second = pipeline.build(spark, str(tmp_path / "c"), out, make=make, every=2)
    assert second["units_failed"] == 0 and names() == {"Anna", "Boris", "Clara"}
    replies = spark.read.parquet(f"{out}/intermediate/replies")
    assert replies.count() == 7  # six units, and one of them twice
    unit = store.load(spark, out, "text_units").where("chunk_index = 3").first()
    assert unit.entities == ["Boris|1|Unknown", "Clara|1|Unknown"] and len(unit.relationships) == 1
    held = store.load(spark, out, "communities").first()
    assert len(held.relationships) == 2 and held.text_unit_ids == [f"book1_chunk_{i + 1}" for i in range(6)]


def test_failing_models_in_search(spark, tmp_path):
    class Deaf(providers.Offline):
        def embed(self, texts):
            raise OSError("down")

        def rerank(self, query, documents, top_n=None):
            raise OSError("down")

    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "01_B_chunks.json").write_text(json.dumps([{"text": "Anna met Clara."}, {"text": "Dora met Anna."}]))
    out = str(tmp_path / "i")
    pipeline.build(spark, str(tmp_path / "c"), out)
    found = pipeline.search(spark, out, "кто в седьмой книге", top_k_entities=2, make=Deaf)
    assert [e["name"] for e in found.entities] == ["Anna", "Clara"] and found.sources == [] and "### Relationships для Anna:" in found.context
    rows = spark.createDataFrame([("b", "x", 2.0), ("a", "y", 3.0), ("c", "z", 1.0)], "id string, doc string, d double")
    assert [r.id for r in providers.reranked(rows, "q", "doc", 2, "id", Deaf, "d").orderBy(F.desc("score")).collect()] == ["c", "b"]


def test_local_context_under_one_budget(spark):
    few = spark.createDataFrame([("a", 0, "A", "T", "x" * 40), ("b", 1, "B", "T", "y" * 8)], "entity string, entity_idx int, name string, type string, description string")
    owned = spark.createDataFrame([("a", 1, "e" * 40), ("a", 2, "f" * 400), ("a", 3, "g" * 8)], "entity string, k int, text string")
    got = [(r.entity_idx, r.kind, r.k) for r in pipeline.local_context(few, owned, 60).collect()]
    assert sorted(got) == [(0, "edge", 1), (0, "entity", 0), (0, "header", 0), (1, "entity", 0)]


def test_http_provider():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            reply = {
                "/chat/completions": lambda: {"choices": [{"message": {"content": body["messages"][0]["role"] + ":" + body["messages"][-1]["content"]}}]},
                "/embeddings": lambda: {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]},
                "/rerank": lambda: {"results": [{"index": 1, "relevance_score": 0.9}]},
            }[self.path]()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    own = providers.Http(base, base, base, system="s", timeout=10)
    assert own.generate(["p"]) == ["system:p"] and own.embed(["a", "b"]) == [[1.0], [2.0]] and own.rerank("q", ["a", "b"]) == [(1, 0.9)]
    server.shutdown()
    found = providers._each([1, 0, 2], lambda x: 1 // x, 2, in_flight=3, base=0.0)
    assert [v for v, _ in found] == [1, None, 0] and found[1][1].startswith("ZeroDivisionError")


def test_knn_batch_in_parts(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = table.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "embedding as query")
    rows = lambda df: sorted((r.query_id, r.rank, r.vec_id) for r in df.collect())
    assert rows(vectors.knn_batch(table, queries, 3)) == rows(vectors.knn_batch(table, queries, 3, most_bytes=3000))


def test_stream_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"id": "book1_chunk_1", "text": "Anna met Boris", "book_number": 1, "global_chunk_index": 0, "headings": []}), encoding="utf-8")
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r.name for r in spark.read.parquet(str(tmp_path / "out" / "entity_mentions")).collect()} == {"Anna", "Boris"}


def test_compat_reader(spark, tmp_path):
    (tmp_path / "data").mkdir()
    import pandas as pd

    pd.DataFrame([{"source": "a", "target": "b", "book_number": 1, "chapter": "c", "description": "", "descriptions_raw": '["x"]', "type": "t", "weight": 0.5, "text_unit_ids": '["u"]'}]).to_parquet(tmp_path / "data" / "relationships.parquet")
    import hashlib

    assert store.load_compat(spark, str(tmp_path), "relationships").first().id == hashlib.md5(b"a|b|1|c").hexdigest()


def test_sentences_keep_digits_that_are_their_place(spark):
    found = spark.range(1).select(T.sentences(F.lit("0 и 0. 1 и 1. Да. 3 раза 33. 44 раза из 4")).alias("s")).first().s
    assert found == ["0 и 0.", "1 и 1.", "Да.", "3 раза 33.", "44 раза из 4"]


@pytest.fixture(scope="module")
def digits(spark, tmp_path_factory):
    """Documents of sentences that start and end with their place's digits, long ones too, and the SQL's view of them."""
    at = str(tmp_path_factory.mktemp("digits"))
    texts = [" ".join(f"{i} {'word ' * (i * k)}and {i}." for i in range(24)) for k in (0, 1, 9)] + [None, "", "0. 1. 2", "1 word 1. 1 word 1. 22 words 22"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    return at, c


def test_greedy_chunks_keep_digits(spark, digits):
    want = digits[1].execute(registry.ORACLE_SQL["greedy_chunks"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["greedy_chunks"](spark, digits[0]).collect())) == sorted(want)


def test_chunk_stats_keep_digits(spark, digits):
    want = digits[1].execute(registry.ORACLE_SQL["chunk_stats"]).fetchall()
    assert list(map(tuple, registry.QUERIES["chunk_stats"](spark, digits[0]).collect())) == want
