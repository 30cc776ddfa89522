"""python -m chronokg build|search|classic_search|parse|chunk|process|batch: the engine from a shell."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronokg.functions.text import book_list, quarter
from chronokg.operators.chunking import chunk_document, chunk_hybrid
from chronokg.plans import pipeline, report
from chronokg.sources import store

PARSED, CHUNKS = "output/parsing_and_chunks/processed", "output/parsing_and_chunks/chunks"


def _parsing(p: argparse.ArgumentParser) -> None:
    p.add_argument("--parser", help="module:function that turns a PDF's bytes into a parsed document's JSON text")
    p.add_argument("--ocr", action="store_true", help="passed to the parser")
    p.add_argument("--tables", action=argparse.BooleanOptionalAction, default=False, help="passed to the parser")
    p.add_argument("--no-filter-toc", dest="filter_toc", action="store_false")
    p.add_argument("--toc-max-page", type=int, default=5)


def _chunking(p: argparse.ArgumentParser) -> None:
    p.add_argument("--model", help="a tokenizer's file, or module:function that counts a text's tokens; without it a quarter of the characters counts")
    p.add_argument("--max-tokens", type=int, default=512)
    p.add_argument("--chunking-method", choices=["hybrid", "sentence"], default="sentence")
    p.add_argument("--no-merge-peers", dest="merge_peers", action="store_false")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="chronokg")
    sub = out.add_subparsers(dest="command", required=True)
    p = sub.add_parser("build")
    p.add_argument("chunks_dir"), p.add_argument("output_dir"), p.add_argument("--window-size", type=int, default=20), p.add_argument("--overlap", type=int, default=5)
    p = sub.add_parser("search")
    p.add_argument("index_dir"), p.add_argument("query"), p.add_argument("--books", type=book_list), p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--top-k-entities", type=int, default=10), p.add_argument("-o", "--output")
    p = sub.add_parser("classic_search")
    p.add_argument("index_dir"), p.add_argument("query"), p.add_argument("--top-k-search", type=int, default=50), p.add_argument("--top-k-rerank", type=int, default=5)
    p.add_argument("--use-reranker", action=argparse.BooleanOptionalAction, default=True), p.add_argument("-o", "--output")
    p = sub.add_parser("parse")
    p.add_argument("input"), p.add_argument("output"), _parsing(p)
    p = sub.add_parser("chunk")
    p.add_argument("input"), p.add_argument("output"), _chunking(p)
    for name, source in (("process", "input"), ("batch", "input_dir")):
        p = sub.add_parser(name)
        p.add_argument(source), p.add_argument("--parsed-dir", default=PARSED), p.add_argument("--chunks-dir", default=CHUNKS), _parsing(p), _chunking(p)
    return out


def _named(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def pdf_parser(a: argparse.Namespace) -> Callable[[bytes], str]:
    """The parser that --parser names; there is none of our own."""
    if not a.parser:
        raise ValueError("no PDF parser: name one by --parser module:function")
    found = _named(a.parser)
    options = {k: v for k, v in (("ocr", a.ocr), ("tables", a.tables)) if v}
    return (lambda content: found(content, **options)) if options else found


def counter(model: str | None) -> Callable[[str], int]:
    """A text's tokens by a tokenizer's JSON file or a function; by a quarter of its characters without either."""
    if not model:
        return quarter
    if not model.endswith(".json"):
        return _named(model)
    held: list = []

    def count(text: str) -> int:
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(model))
        return len(held[0].encode(text, add_special_tokens=False).ids)

    return count


def chunked(documents: DataFrame, a: argparse.Namespace) -> DataFrame:
    elements, count = store.elements(documents), counter(a.model)
    chunks = chunk_hybrid(elements, a.max_tokens, a.merge_peers, count=count) if a.chunking_method == "hybrid" else chunk_document(elements, a.max_tokens, count=count)
    return chunks.withColumn("filename", F.col("doc_id"))


def documents(spark: SparkSession, a: argparse.Namespace) -> int:
    """The commands on documents; 1 if any file failed."""
    if a.command == "chunk":
        print(store.write_chunks(chunked(store.read_documents(spark, a.input), a), a.output))
        return 0
    source = a.input_dir if a.command == "batch" else a.input
    parsed, failed = store.parse_pdfs(spark, source, pdf_parser(a), a.filter_toc, a.toc_max_page)
    written = store.write_documents(parsed, a.output if a.command == "parse" else a.parsed_dir)
    if written and a.command != "parse":
        print(store.write_chunks(chunked(parsed, a), a.chunks_dir))
    errors = failed.orderBy("file").collect()
    print(f"{len(written)} of {len(written) + len(errors)} files")
    for r in errors:
        print(f"- {r.file}: {r.error}", file=sys.stderr)
    return int(bool(errors) or not written)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("chronokg").getOrCreate()
    if a.command == "build":
        print(pipeline.build(spark, a.chunks_dir, a.output_dir, a.window_size, a.overlap))
        return 0
    if a.command in ("parse", "chunk", "process", "batch"):
        return documents(spark, a)
    if a.command == "search":
        found = pipeline.search(spark, a.index_dir, a.query, a.books, a.top_k, a.top_k_entities)
    else:
        found = pipeline.classic_search(spark, a.index_dir, a.query, a.top_k_search, a.top_k_rerank, a.use_reranker)
    print(report.summary(found))
    if a.output:
        for file in report.save(found, str(Path(a.output))):
            print(file)
    return 0


if __name__ == "__main__":
    sys.exit(main())
