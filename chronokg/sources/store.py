"""Reading and writing chunk files, parsed documents and the index tables."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronokg import schemas
from chronokg.functions.text import book_number, book_title, relationship_id, tokens
from chronokg.operators.positions import dense_index, relative_position

TABLES = {"entities": schemas.ENTITIES, "relationships": schemas.RELATIONSHIPS, "communities": schemas.COMMUNITIES, "text_units": schemas.TEXT_UNITS}


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the cluster names; where none is named only a local master has one of its own."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        if not named:
            own = os.path.join(tempfile.gettempdir(), "chronokg-checkpoints")
            os.makedirs(own, exist_ok=True)
            named = f"file://{own}"
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Text units of a folder of chunk files, with defaults filled in and positions in file, then list order.

    A file ``NN_Title_chunks.json`` is a JSON list, a book; one whose root is
    something else, or that doesn't parse, fails the job by name.
    """
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path).select(F.col("_metadata.file_name").alias("_file"), "value")
    if files.isEmpty():
        raise FileNotFoundError(f"no chunks in {path}")
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{schemas.CHUNK_FILE}>>", {"mode": "PERMISSIVE"}))
    wrong = F.raise_error(F.concat(F.lit("not a JSON list of chunks: "), "_file")).cast("int")
    checked = files.select("_file", rows.alias("rows")).select("_file", F.coalesce(F.when(F.col("rows").isNotNull(), 1), wrong).alias("_ok"), F.size("rows").alias("_n"), "rows").where("_ok = 1")
    placed = checked.select("_file", "_n", F.posexplode("rows").alias("chunk_index", "c")).select("_file", "_n", "chunk_index", "c.*")
    placed = placed.withColumn("book_number", book_number(F.col("_file")))
    text = F.coalesce("text", F.lit(""))
    units = placed.select(
        "_file", F.concat(F.lit("book"), "book_number", F.lit("_"), F.coalesce("chunk_id", F.concat(F.lit("chunk_"), F.col("chunk_index") + 1))).alias("id"),
        text.alias("text"), F.coalesce("contextualized_text", text).alias("contextualized_text"), F.coalesce("text_tokens", "tokens", F.lit(0)).alias("text_tokens"),
        "book_number", book_title(F.col("_file")).alias("book_title"), "chunk_index",
        relative_position(F.col("chunk_index"), F.col("_n")).alias("relative_position"), F.when(F.size("headings") > 0, F.col("headings")).alias("headings"), "metadata",
    )
    return dense_index(units, ["_file", "chunk_index"]).drop("_file")


def _write_files(files: DataFrame, path: str) -> list[str]:
    """Write each row (name, body) as a file of its own in ``path``; the names. A retried task writes a draft and renames it."""
    target = path if urlparse(path).scheme else f"file://{os.path.abspath(path)}"

    def run(batches):
        system, folder = fs.FileSystem.from_uri(target)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(body.encode())
                system.move(draft, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

    return sorted(r.name for r in files.select("name", "body").mapInArrow(run, "name string").collect())


def stem(file):
    """A file's name without its ending."""
    return F.regexp_replace(file, r"\.[^.]*$", "")


def write_chunks(chunks: DataFrame, path: str, doc: str = "doc_id") -> dict:
    """A file ``<document>_chunks.json`` for each document, its chunks as a JSON list in order, as read_chunks() reads them; the chunks' number and average, least and most tokens."""
    kept = [c for c in chunks.columns if c != doc]
    number = F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("long")
    rows = chunks.groupBy(doc).agg(F.transform(F.sort_array(F.collect_list(F.struct(number.alias("k"), F.struct(*kept).alias("c")))), lambda x: x["c"]).alias("rows"))
    held = checkpointed(chunks.select("tokens"))
    _write_files(rows.select(F.concat(stem(F.col(doc)), F.lit("_chunks.json")).alias("name"), F.to_json("rows", {"ignoreNullFields": "false"}).alias("body")), path)
    return held.agg(F.count("*").alias("n"), F.avg("tokens").alias("avg"), F.min("tokens").alias("min"), F.max("tokens").alias("max")).first().asDict()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, with the file's name."""
    return spark.read.schema(schemas.PARSED_DOCUMENT).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def write_documents(documents: DataFrame, path: str) -> list[str]:
    """Each parsed document as a JSON file of its own; the names."""
    fields = [c for c in documents.columns if c != "file"]
    return _write_files(documents.select(F.concat(stem(F.col("file")), F.lit(".json")).alias("name"), F.to_json(F.struct(*fields), {"pretty": "true"}).alias("body")), path)


def repaired(documents: DataFrame, filter_toc: bool = True, toc_max_page: int = 5) -> DataFrame:
    """Parsed documents without entries of tables of contents, and with tables that are chapter headings labelled as such."""
    from chronokg.operators.chunking import keep_element, table_heading

    texts = F.filter("texts", lambda e: keep_element(e["label"], F.get(e["prov"], 0)["page_no"], e["text"], toc_max_page)) if filter_toc else F.col("texts")
    relabel = lambda t: F.when(table_heading(t["data"]["table_cells"]["text"]), "section_header").otherwise(t["label"])
    tables = F.transform("tables", lambda t: F.struct(relabel(t).alias("label"), t["data"].alias("data")))
    return documents.withColumn("texts", texts).withColumn("tables", tables)


def elements(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, label, level, text, page) of the text elements of parsed documents; tables aren't text elements."""
    body = documents.select(F.col("file").alias("doc_id"), F.posexplode("texts").alias("pos", "e"))
    return body.select("doc_id", "pos", F.coalesce("e.label", F.lit("")).alias("label"), "e.level", "e.text", F.get("e.prov.page_no", 0).alias("page")).where("text is not null")


def read_pdfs(spark: SparkSession, path: str, parse) -> DataFrame:
    """(path, document, error): each PDF through ``parse(bytes) -> JSON text``; a file's failure is its own row's."""

    def run(batches):
        for batch in batches:
            found = []
            for content in batch.column(1).to_pylist():
                try:
                    found.append((parse(content), None))
                except Exception as e:
                    found.append((None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for d, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=["path", "document", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, document string, error string")


def parse_pdfs(spark: SparkSession, path: str, parse, filter_toc: bool = True, toc_max_page: int = 5) -> tuple[DataFrame, DataFrame]:
    """(repaired documents, failures (file, error)) of the PDFs at ``path``; a reply that is no JSON object is a failure."""
    name = F.element_at(F.split("path", "/"), -1)
    parsed = checkpointed(read_pdfs(spark, path, parse).select(name.alias("file"), F.from_json("document", schemas.PARSED_DOCUMENT).alias("d"), F.ltrim("document").startswith("{").alias("ok"), "error"))
    good = F.coalesce(F.col("ok"), F.lit(False)) & F.col("d").isNotNull()
    documents = parsed.where(good).select("d.*", "file")
    return repaired(documents, filter_toc, toc_max_page), parsed.where(~good).select("file", F.coalesce("error", F.lit("no parsed document")).alias("error"))


def save(df: DataFrame, base: str, table: str) -> None:
    """Write an index table, a folder to each book."""
    df.write.mode("overwrite").partitionBy("book_number").parquet(f"{base}/data/{table}")


def load(spark: SparkSession, base: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{base}/data/{table}")


def load_index(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """All four tables; keys are unique in them, as each build writes them whole."""
    return {table: load(spark, base, table) for table in TABLES}


def load_compat(spark: SparkSession, base: str, table: str) -> DataFrame:
    """A table of the older layout: one file, lists as JSON strings, edge ids not stored."""
    raw = spark.read.parquet(f"{base}/data/{table}.parquet")
    lists = lambda *names: {n: F.from_json(n, "array<string>") for n in names}
    if table == "entities":
        return raw.withColumns(lists("descriptions_raw", "text_unit_ids"))
    if table == "relationships":
        return raw.withColumns(lists("descriptions_raw", "text_unit_ids")).withColumn("id", relationship_id(F.col("source"), F.col("target"), F.col("book_number"), F.col("chapter")))
    if table == "communities":
        return raw.withColumns(lists("entities", "relationships"))
    position = F.from_json("temporal_position", "book_number int, book_title string, chunk_index int, global_chunk_index long, relative_position double, chapter string")
    out = raw.withColumns(lists("entities", "relationships")).withColumn("_p", position).withColumn("headings", F.from_json("metadata", "headings array<string>")["headings"])
    return out.select("id", "text", "book_number", F.col("_p.book_title").alias("book_title"), "chunk_index", F.col("_p.global_chunk_index").alias("global_chunk_index"), F.col("_p.relative_position").alias("relative_position"), F.coalesce(F.col("_p.chapter"), F.col("chunk_index").cast("string")).alias("chapter"), "entities", "relationships", "headings", F.col("text").alias("contextualized_text"), tokens(F.col("text")).alias("text_tokens"))


def index_statistics(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Rows and embedded rows of each table."""
    out: dict[str, int] = {}
    for name, df in tables.items():
        has = F.size("embedding") > 0 if "embedding" in df.columns else F.lit(False)
        row = df.agg(F.count("*").alias("n"), F.count_if(has).alias("e"), F.max(F.when(has, F.size("embedding")) if "embedding" in df.columns else F.lit(None)).alias("d")).first()
        out |= {f"total_{name}": row.n, f"{name}_with_embeddings": row.e}
        out["embedding_dim"] = out.get("embedding_dim") or row.d or 0
    return out


def write_metadata(spark: SparkSession, base: str, statistics: dict) -> None:
    spark.createDataFrame([(json.dumps({"version": "1.0", **statistics}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/metadata")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def done(spark: SparkSession, base: str, table: str) -> bool:
    """Whether a stage's table was written whole."""
    return exists(spark, f"{base}/{table}/_SUCCESS")


def unprocessed(units: DataFrame, processed: DataFrame, id: str = "id") -> DataFrame:
    """The units that a checkpoint doesn't hold yet."""
    return units.join(processed.select(id).distinct(), id, "left_anti")
