"""Quality by importance resampling.

Two generative models of hashed word unigrams and bigrams, one of target texts
and one of all raw texts, give each document the log of the ratio of its
probabilities. Documents are sampled without replacement in proportion to that
ratio by the Gumbel top-k trick: the k highest of log ratio plus Gumbel noise,
where the noise is a hash of the id, so that a rerun draws the same.
"""

from __future__ import annotations

from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronokg.llm.common import WORD_BYTES, arrow_batches, as_bytes, materialize

#: Buckets of the models; target documents at most (those of least hash of id); the share of documents that is drawn; added to each bucket's count.
BUCKETS, TARGETS, SHARE, SMOOTH = 16_384, 20_000, 0.5, 1.0


def grams(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of a text's words and neighbouring pairs."""
    words = text.translate(WORD_BYTES).split()
    own = np.fromiter(map(crc32, words), np.uint64, len(words))
    pairs = own[:-1] * np.uint64(0x9E3779B1) + own[1:] * np.uint64(0x85EBCA77)
    return (np.concatenate([own * np.uint64(0x9E3779B1) >> np.uint64(7), (pairs >> np.uint64(13)) + np.uint64(1)]) % np.uint64(buckets)).astype(np.int64)


def models(docs: DataFrame, targets: set[int], doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all documents and over those whose id is in ``targets``; a row per bucket and task is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(targets)

    def run(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.bincount(grams(body, buckets), minlength=buckets)
                raw += own
                if i in shared.value:
                    target += own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("i"), as_bytes(docs, text).alias("body")).mapInArrow(run, "bucket long, raw long, target long")
    out = np.zeros((2, buckets), np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        out[:, r.bucket] = r.raw, r.target
    return out[0], out[1]


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), smoothed; zeros if there are no targets."""
    if not target.sum():
        return np.zeros(len(raw))
    p, q = target + SMOOTH, raw + SMOOTH
    return np.log(p / p.sum()) - np.log(q / q.sum())


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a double column by counts over ever narrower ranges, 4096 at a time; null and NaN are left out."""
    if k <= 0:
        return None
    now = keys.where(F.col(column).isNotNull() & ~F.isnan(column)).select(F.col(column).alias("v"))
    first = now.agg(F.min("v"), F.max("v"), F.count("*")).first()
    low, high, n = first
    if not n or k > n:
        return low
    while low < high:
        step = (high - low) / 4096
        if not step or low + step == low:
            break
        place = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(step)), F.lit(4095))
        counts = sorted(((r.place, r.n, r.low, r.high) for r in now.where((F.col("v") >= low) & (F.col("v") <= high)).groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()), reverse=True)
        for _, held, least, most in counts:
            if k <= held:
                low, high = least, most
                break
            k -= held
    return high


def score(docs: DataFrame, ratios: np.ndarray, doc_id: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """(doc_id, n_grams, log_ratio, gumbel_key) per row. A text without words has log ratio 0; a null id draws as "" does."""
    shared, size = docs.sparkSession.sparkContext.broadcast(ratios), len(ratios)

    def run(batches):
        own = shared.value
        for batch in batches:
            found = [grams(body, size) for body in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(g) for g in found], pa.int64()), pa.array([float(own[g].sum()) for g in found], pa.float64())],
                names=["doc_id", "draw", "n_grams", "log_ratio"],
            )

    draw = F.xxhash64(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.lit(seed))
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), as_bytes(docs, text).alias("body"), draw.alias("draw"))
    scored = given.mapInArrow(run, "doc_id long, draw long, n_grams long, log_ratio double")
    uniform = (F.shiftrightunsigned("draw", 11).cast("double") + 0.5) / float(1 << 53)
    return scored.select("doc_id", "n_grams", "log_ratio", (F.col("log_ratio") - F.log(-F.log(uniform))).alias("gumbel_key"))


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, buckets: int = BUCKETS, targets: int = TARGETS, seed: int = 42, doc_id: str = "doc_id", text: str = "text", good: str = "quality") -> DataFrame:
    """(doc_id, n_grams, log_ratio, score, gumbel_key, selected) for every row of ``docs``.

    Target documents are the ``targets`` ids of least hash among labels whose
    ``good`` is 1; both models count whole texts of every document. ``score`` is
    the ratio per gram as a probability; ``selected`` marks the ``share`` of the
    rows (rounded up) with the highest keys, ties all in. Without targets all
    ratios are 0 and the sample is uniform; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    rows = labels.where((F.col(f"`{good}`") == 1) & F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("i")).distinct()
    ids = {r.i for r in rows.orderBy(F.xxhash64("i"), "i").limit(targets).collect()}
    scored = materialize(score(docs, log_ratios(*models(docs, ids, doc_id, text, buckets)), doc_id, text, seed))
    n = scored.count()
    least = kth_largest(scored, "gumbel_key", int(np.ceil(share * n)))
    chance = 1 / (1 + F.exp(-F.col("log_ratio") / F.greatest("n_grams", F.lit(1)) * 20))
    return scored.select("doc_id", "n_grams", "log_ratio", chance.alias("score"), "gumbel_key", (F.col("gumbel_key") >= F.lit(least)).alias("selected"))
