"""Benchmark decontamination by a prefix-filtered set join.

Each window of ``WINDOW`` consecutive item words (all of a shorter item) is a set
of shingles of ``SHINGLE`` words. A text that holds a window holds all of its
shingles, so under any order of the shingles a prefix of one is enough: windows
are posted under their rarest shingle alone, by counts over all documents. A
document's shingles are joined with the postings; the place of the shingle in
the window bounds where a window would start and end, and what passes is
verified word by word.

Benchmark items are read in slices of at most ``ITEM_BYTES`` of text (measured
before), and only a slice's index is broadcast. An index is flat arrays, of about
20 bytes for a word of its items, besides its distinct words: at most some 12
times the text. More slices are more passes over the documents, with the hits so
far carried along.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronokg.llm.common import WORD_BYTES, arrow_batches, as_bytes, fresh, materialize

WINDOW, SHINGLE, ITEM_BYTES = 10, 5, 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Index:
    """The windows of some items, their words as numbers from 1, and their shingles, all in flat arrays."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.words: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        rows = [np.array([self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)], np.int32) for _, text in items]
        self.flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
        self.flat_len = len(self.flat)
        starts, sizes, owners, at = [], [], [], 0
        for k, row in enumerate(rows):
            n = max(1, len(row) - WINDOW + 1) if len(row) else 0
            starts.append(np.arange(at, at + n, dtype=np.int64))
            sizes.append(np.full(n, min(WINDOW, len(row)), np.int8))
            owners.append(np.full(n, k, np.int32))
            at += len(row)
        self.starts, self.sizes, self.owners = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, sizes, owners))
        widths = np.minimum(self.sizes, SHINGLE)
        #: By width, the windows and the sorted keys of all their shingles.
        self.members = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
        self.shingles = {w: np.unique(np.concatenate([self._cut(own, w, k) for k in range(WINDOW - w + 1)])) for w, own in self.members.items()}
        self.postings: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _cut(self, windows: np.ndarray, width: int, k: int) -> np.ndarray:
        """Keys of the k-th shingle of those of the windows that have one."""
        own = self.starts[windows[self.sizes[windows] >= k + width]] + k
        return self._keys(np.stack([self.flat[own + i] for i in range(width)], axis=-1).astype(np.uint64))

    @staticmethod
    def _keys(rows: np.ndarray) -> np.ndarray:
        key = np.zeros(rows.shape[:-1], np.uint64)
        for k in range(rows.shape[-1]):
            key = (key ^ rows[..., k]) * _BASE
            key ^= key >> np.uint64(31)
        return key

    def meet(self, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the text's shingles that are shingles of windows."""
        n = len(ids) - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        known, at = ids > 0, slice(0, n)
        every = known[at].copy()
        for k in range(1, width):
            every &= known[k : n + k]
        places = np.flatnonzero(every)
        keys = self._keys(np.stack([ids[places + k] for k in range(width)], axis=-1).astype(np.uint64)) if len(places) else np.empty(0, np.uint64)
        held = self.shingles[width]
        good = held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys
        return places[good], keys[good]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.get, words, repeat(0)), np.int64, len(words))

    def post(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Put each window under its rarest shingle, the first of equals; ``counts`` of sorted ``keys``, others count as none."""
        for width, own in self.members.items():
            best = np.full(len(own), np.iinfo(np.int64).max)
            posted, place = np.zeros(len(own), np.uint64), np.zeros(len(own), np.int8)
            for k in range(WINDOW - width + 1):
                has = np.flatnonzero(self.sizes[own] >= k + width)
                if not len(has):
                    break
                key = self._cut(own, width, k)
                at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                n = np.where(keys[at] == key, counts[at], 0) if len(keys) else np.zeros(len(key), np.int64)
                rarer = n < best[has]
                best[has[rarer]], posted[has[rarer]], place[has[rarer]] = n[rarer], key[rarer], k
            order = np.argsort(posted, kind="stable")
            self.postings[width] = posted[order], own[order], place[order]

    def hits(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words inside windows, in order and not touching, and the items."""
        marks, items, n = [], set(), len(ids)
        for width, (posted, windows, offset) in self.postings.items():
            places, keys = self.meet(ids, width)
            first, last = np.searchsorted(posted, keys, "left"), np.searchsorted(posted, keys, "right")
            for p in np.flatnonzero(last > first).tolist():
                own = slice(first[p], last[p])
                w = windows[own]
                begin = places[p] - offset[own]
                size = self.sizes[w].astype(np.int64)
                fits = np.flatnonzero((begin >= 0) & (begin + size <= n))
                # Words of all windows at once; a shorter window's last word stands for what it lacks.
                step = np.minimum(np.arange(WINDOW)[None, :], size[fits, None] - 1)
                same = (ids[begin[fits, None] + step] == self.flat[self.starts[w[fits], None] + step]).all(axis=1)
                for k in fits[same].tolist():
                    marks.append((int(begin[k]), int(begin[k] + size[k])))
                    name = self.names[self.owners[w[k]]]
                    if name is not None:
                        items.add(name)
        return joined(marks), items


def joined(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _counts(docs: DataFrame, index) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the index's shingles and how often each stands in all documents; as many as the index has shingles at most."""

    def run(batches):
        own, held = index.value, []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = own.numbers(words_of(text))
                held += [own.meet(ids, width)[1] for width in own.shingles]
                if len(held) > 20_000:
                    held = [np.concatenate(held)]
                    if len(held[0]) > 1_000_000:
                        yield rows(held)
                        held = []
        yield rows(held)

    def rows(held):
        keys, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["k", "n"])

    found = docs.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    keys, n = found.column("k").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_spans (start and end of words inside windows) and hit_items (sorted item ids, as strings).

    A null text has no words and is never hit; an item without words has no
    windows; words of an item with a null id are hit but name no item; equal
    items under two ids are both named; an empty benchmark hits nothing. Columns
    of ``docs`` with these three names are replaced.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), as_bytes(benchmark, item_text).alias("body"))
    size = items.agg(F.sum(F.length("body"))).first()[0] or 0
    slices = max(1, -(-size // item_bytes))
    added = ["n_words", "hit_spans", "hit_items"]
    out = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in added])
    kept, body, done = out.columns, fresh(out, "body"), fresh(out, "done")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    types = "array<struct<start:int,end:int>>", "array<string>"
    now = out.select("*", as_bytes(out, text).alias(body), F.array().cast(types[0]).alias(f"{done}_s"), F.array().cast(types[1]).alias(f"{done}_i"))
    for k in range(slices):
        rows = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(slices)) == k).collect()
        index = Index([(r.item, bytes(r.body)) for r in rows])
        first = spark.sparkContext.broadcast(index)
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        index.post(*(_counts(now.select(body), first) if index.flat_len else none))
        first.unpersist()
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            own = shared.value
            for batch in batches:
                *rest, texts, old_spans, old_items = batch.columns
                n_words, hit, named = [], [], []
                for given, before, ids in zip(texts.to_pylist(), old_spans.to_pylist(), old_items.to_pylist()):
                    words = words_of(given)
                    marks, items = own.hits(own.numbers(words)) if own.flat_len else ([], set())
                    n_words.append(len(words))
                    hit.append([{"start": a, "end": b} for a, b in joined([*marks, *((x["start"], x["end"]) for x in before)])])
                    named.append(sorted(items | set(ids)))
                new = [pa.array(n_words, pa.int64()), pa.array(hit, spans), pa.array(named, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*rest, texts, *new], names=[*kept, body, *added])

        schema = now.select(*[f"`{c}`" for c in kept], body, F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(types[0]).alias("hit_spans"), F.lit(None).cast(types[1]).alias("hit_items")).schema
        now = now.mapInArrow(run, schema)
        if k < slices - 1:
            now = materialize(now).select(*[f"`{c}`" for c in kept], body, F.col("hit_spans").alias(f"{done}_s"), F.col("hit_items").alias(f"{done}_i"))
    return now.select(*[f"`{c}`" for c in kept], *added)


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The digest columns of contamination()."""
    n_hit = F.expr("aggregate(hit_spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select(
        F.col(doc_id), "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
