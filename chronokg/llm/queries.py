"""The operators of this subpackage applied to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronokg.llm import bpe, decontaminate, html_extract, licenses, packed_ids, quality, secrets, simhash, topk, toxicity
from chronokg.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))


def op5_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packed_ids.new_folder(spark)
    manifest = packed_ids.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2, out, added=True)
    return packed_ids.read_ids(manifest, out)


def owner_columns():
    """The corpus names no repository: a source owns one for each of its languages."""
    return F.concat_ws("/", "source", "lang"), F.col("source")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    repository, owner = owner_columns()
    return secrets.digest(*secrets.scan(table(spark, sf_dir, "documents"), ["doc_id"], "text", repository, owner))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(*licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"]))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_html_extraction, op3_byte_bpe, op4_decontamination, op5_packed_token_ids,
        op6_secret_scan, op7_license_scan, op8_exact_top_k, op9_quality_resampling, op10_toxicity,
    )
}

_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": rf"""
        WITH d AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM benchmark),
        windows AS (
            SELECT item_id, list_slice(w, s, s + least(10, len(w)) - 1) AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT len(g) AS n FROM windows),
        places AS (
            SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)),
        hits AS (SELECT DISTINCT doc_id, item_id, s, n FROM places JOIN windows USING (g)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op8_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
        SELECT * FROM ranked WHERE rank <= 5""",
}
