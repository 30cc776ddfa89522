"""Toxicity by a counterfactual-regularised linear classifier.

Features are a document's distinct words and their beginnings, hashed. Labelled
documents that name a group get twins in which each identity term is swapped for
another of its kind; besides the logistic loss, the squared change of score
between twins is penalised, so that a neutral mention of a group doesn't weigh.
Weights are not negative and an L1 penalty selects them, so ordinary words have
none, which keeps long documents clean and doesn't let them hide a toxic word;
the selected ones are fitted again without it.
"""

from __future__ import annotations

from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronokg.llm.common import WORD_BYTES, arrow_batches, as_bytes, fresh

#: Bits of the hashed features; labelled documents of each class at most (those of least hash of id).
BITS, LABELLED = 20, 2_000
#: L1 penalty, weight of the counterfactual penalty, epochs of training, words kept by a worker.
L1, COUNTERFACTUAL, EPOCHS, KEPT = 5e-4, 5.0, 120, 100_000

#: Terms for groups, by kind; a term is swapped for the next of its kind.
IDENTITY = (
    "christian muslim jewish hindu buddhist sikh atheist catholic protestant mormon", "christians muslims jews hindus buddhists sikhs atheists catholics protestants mormons",
    "white black asian latino hispanic arab african european indigenous", "american mexican chinese indian russian german french nigerian turkish polish",
    "gay lesbian bisexual transgender straight queer heterosexual homosexual", "man woman", "men women", "male female", "boy girl", "boys girls",
    "young old elderly", "deaf blind disabled autistic", "immigrant refugee foreigner native", "immigrants refugees foreigners natives",
    "christ muslime jude hindu", "frau mann", "frauen männer", "femme homme", "femmes hommes", "mujer hombre", "mujeres hombres",
)
SWAP = {a.encode(): b.encode() for kind in IDENTITY for a, b in zip(kind.split(), [*kind.split()[1:], kind.split()[0]])}


def words_of(text: bytes) -> set[bytes]:
    return set(text.translate(WORD_BYTES).split())


def features(word: bytes, bits: int = BITS) -> list[int]:
    """A word's buckets: itself, and its first 4, 5 and 6 bytes if it is longer than those."""
    mask = (1 << bits) - 1
    return [crc32(b"=" + word) & mask, *(crc32(b"^" + word[:n]) & mask for n in (4, 5, 6) if len(word) > n)]


def swapped(words: set[bytes]) -> set[bytes] | None:
    """The words with identity terms swapped; None if there are none."""
    return {SWAP.get(w, w) for w in words} if not words.isdisjoint(SWAP) else None


def encode(words: set[bytes], bits: int = BITS) -> np.ndarray:
    return np.array([f for w in words for f in features(w, bits)], np.int32)


class Rows:
    """Sparse rows of counts, over the given columns only."""

    def __init__(self, rows: list[np.ndarray], columns: np.ndarray):
        self.n, self.width = len(rows), len(columns)
        flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
        row = np.repeat(np.arange(self.n), [len(r) for r in rows]) if rows else np.empty(0, np.int64)
        column = np.minimum(np.searchsorted(columns, flat), max(0, self.width - 1))
        held = columns[column] == flat if self.width else np.zeros(len(flat), bool)
        self.row, self.column = row[held], column[held]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, r[self.row], self.width)


def fit(rows: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, twins: list[tuple[np.ndarray, np.ndarray]], l1: float = L1, counterfactual: float = COUNTERFACTUAL, epochs: int = EPOCHS) -> tuple[dict[int, float], float]:
    """Weights of features and bias; ``twins`` are pairs of a row and its counterfactual. One class alone gives its prior."""
    share = float(np.clip((weight * toxic).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)) if len(rows) else 1e-3
    bias = float(np.log(share / (1 - share)))
    if not len(rows) or toxic.min() == toxic.max():
        return {}, bias
    columns, seen = np.unique(np.concatenate([*rows, *(x for pair in twins for x in pair)]), return_counts=True)
    columns = columns[seen > 1]
    x, a, b = (Rows(part, columns) for part in (rows, [p for p, _ in twins], [q for _, q in twins]))
    w, past, drift, total = np.zeros(len(columns)), np.full(len(columns), 1e-8), 1e-8, weight.sum()
    for epoch in range(2 * epochs):
        if epoch == epochs:  # what the penalty has left is fitted again without it
            past, l1 = np.where(w < 0.05, np.inf, 1e-8), 0.0
            w[w < 0.05] = 0.0
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -30, 30)))
        error = weight * (p - toxic) / total
        slope = x.back(error)
        if a.n:
            change = 2 * counterfactual * (a.dot(w) - b.dot(w)) / a.n
            slope += a.back(change) - b.back(change)
        past += slope * slope
        rate = 0.5 / np.sqrt(past)
        w -= rate * slope
        w = np.maximum(w - rate * l1, 0)
        drift += error.sum() ** 2
        bias -= 0.5 / np.sqrt(drift) * error.sum()
    used = np.flatnonzero(np.abs(w) > 0.02)
    return {int(c): float(v) for c, v in zip(columns[used], w[used])}, bias


def held_out(doc_id):
    """True for rows whose label is never learnt; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, bits: int = BITS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[dict[int, float], float]:
    """Learn from at most ``labelled`` documents of each class, those of least hash of id, weighed to the classes' true shares.

    Held-out and null labels are left out; of a repeated label, and of a repeated
    document, one counts. Only ids are chosen first; the features of those
    documents, not texts, are gathered, so at most twice ``labelled`` rows.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(f"`{label}`").isNotNull() & ~held_out(F.col(f"`{doc_id}`"))).groupBy(F.col(f"`{doc_id}`").alias("i")).agg((F.max(f"`{label}`") > 0).cast("int").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = {r.i: r.y for y in sorted(sizes) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(labelled).collect()}
    shared = spark.sparkContext.broadcast(frozenset(chosen))

    def run(batches):
        for batch in batches:
            out = [(i, w) for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if i in shared.value for w in [words_of(body)]]
            twin = [swapped(w) for _, w in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in out], pa.int64()), pa.array([encode(w, bits).tobytes() for _, w in out], pa.binary()), pa.array([None if t is None else encode(t, bits).tobytes() for t in twin], pa.binary())],
                names=["i", "x", "twin"],
            )

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("i"), as_bytes(docs, text).alias("body")).mapInArrow(run, "i long, x binary, twin binary")
    rows = [r.r for r in rows.groupBy("i").agg(F.min(F.struct("i", "x", "twin")).alias("r")).collect()]
    rows.sort(key=lambda r: (r.i, bytes(r.x)))
    x = [np.frombuffer(r.x, np.int32) for r in rows]
    y = np.array([chosen[r.i] for r in rows], np.float64)
    taken = {k: max(1, sum(1 for v in chosen.values() if v == k)) for k in sizes}
    weight = np.array([sizes[int(v)] / taken[int(v)] for v in y])
    twins = [(np.frombuffer(r.x, np.int32), np.frombuffer(r.twin, np.int32)) for r in rows if r.twin is not None]
    return fit(x, y, weight, twins)


def classify(docs: DataFrame, model: tuple[dict[int, float], float], bits: int = BITS, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the probability that a whole text is toxic; a text without words, and null, get the model's bias. A column named as ``score`` is replaced; no other name clashes."""
    arrow_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != score.lower()]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(*[f"`{c}`" for c in kept], as_bytes(docs, text).alias(fresh(docs, "body")))

    def run(batches):
        weights, bias = shared.value

        @lru_cache(KEPT)
        def of(word: bytes) -> float:
            return sum(weights.get(f, 0.0) for f in features(word, bits))

        for batch in batches:
            sums = np.array([sum(map(of, words_of(body))) for body in batch.column(len(kept)).to_pylist()], np.float64)
            out = 1 / (1 + np.exp(-np.clip(sums + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*kept, score])

    return given.mapInArrow(run, docs.select(*[f"`{c}`" for c in kept], F.lit(0.0).alias(score)).schema)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, with labels learnt from rows that aren't held out.

    No labels predict 0; null ids are held out, repeated rows are scored alike,
    texts of any length are read whole, and an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    found = classify(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), train(docs, labels, doc_id=doc_id, text=text))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
