"""SimHash near-duplicates by anchor-point covering.

A fingerprint of 64 bits is cut into two blocks of 23 bits, one of 15 and three
bits that no block holds. The binary Golay code covers a block of 23 bits with
radius 3 and the Hamming code one of 15 bits with radius 1, both perfectly, so
the product of the three codes is a covering code whose words are the anchors:
each fingerprint has one home anchor. Two fingerprints that differ in at most
``THRESHOLD`` bits meet at the home of either if both are copied to every anchor
within the covering radius plus that threshold, where the threshold's bits are
shared out over the blocks (an anchor further off in one block cannot be the
home of a fingerprint so near). Fingerprints are compared per anchor only.

Equal fingerprints are one before anything is copied, so exact copies cost a
row. Each task turns the links that it finds into a spanning forest, so that a
crowd of near copies yields as many rows as members and not their pairs. A group
over ``CROWD`` members is streamed, not held, and covered anew by the finest code
there is: every point is an anchor, of covering radius 0, and a fingerprint is
copied to the 65 within one bit. Two fingerprints share such an anchor exactly if
they differ in two bits at most, and at most 65 share one.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronokg.llm.common import arrow_batches, as_bytes, fresh, join_counted, materialize
from chronokg.llm.components import components

SEED, SHINGLE, THRESHOLD, CROWD = 42, 3, 2, 512

#: (bits, generator polynomial, covering radius) of each block. The generators of the two perfect codes.
BLOCKS = ((23, 0b101011100011, 3), (23, 0b101011100011, 3), (15, 0b10011, 1))
BATCH = 65_536


def fingerprint(text: bytes) -> int:
    """The SimHash of a UTF-8 text; zero if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    n = max(1, len(words) - SHINGLE + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed number; zero without any."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` without its text and with a long column ``out``: the fingerprint's 64 bits, in place of any column of that name. Null texts have no words."""
    arrow_batches(docs.sparkSession)
    body = fresh(docs, "body")
    kept = [c for c in docs.columns if c != text and c.lower() != out.lower()]
    given = docs.select(*[f"`{c}`" for c in kept], as_bytes(docs, text).alias(body))
    schema = given.drop(body).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            found = pa.array([fingerprint(x) for x in batch.column(len(kept)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*kept, out])

    return given.mapInArrow(run, schema)


def _syndromes(values: np.ndarray, bits: int, generator: int) -> np.ndarray:
    """The remainder of each value by the generator, as polynomials over two elements."""
    degree, left = generator.bit_length() - 1, values.astype(np.uint64)
    for k in range(bits - 1, degree - 1, -1):
        left = left ^ (((left >> np.uint64(k)) & np.uint64(1)) * np.uint64(generator << (k - degree)))
    return left.astype(np.int64)


@cache
def _covers(threshold: int) -> list[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For each block: the syndrome of every value, and by excess 0..threshold the patterns (padded) and their mask, by syndrome."""
    out = []
    for bits, generator, radius in BLOCKS:
        known = _syndromes(np.arange(1 << bits, dtype=np.uint64), bits, generator).astype(np.int16)
        lists: list[list[list[int]]] = [[[] for _ in range(1 << (generator.bit_length() - 1))] for _ in range(threshold + 1)]
        for weight in range(radius + threshold + 1):
            for chosen in combinations(range(bits), weight):
                pattern = sum(1 << b for b in chosen)
                lists[max(0, weight - radius)][known[pattern]].append(pattern)
        tables = []
        for by_syndrome in lists:
            wide = max(map(len, by_syndrome))
            padded, mask = np.zeros((len(by_syndrome), wide), np.uint64), np.zeros((len(by_syndrome), wide), bool)
            for s, patterns in enumerate(by_syndrome):
                padded[s, : len(patterns)], mask[s, : len(patterns)] = patterns, True
            tables.append((padded, mask))
        out.append((known, tables))
    return out


def _parts(fps: np.ndarray, threshold: int):
    at = 0
    for (bits, _, _), (known, tables) in zip(BLOCKS, _covers(threshold)):
        yield at, known[((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64)], tables
        at += bits


_KEPT = np.uint64((1 << sum(b for b, _, _ in BLOCKS)) - 1)


def homes(fps: np.ndarray) -> np.ndarray:
    """Each fingerprint's home anchor."""
    out = fps & _KEPT
    for at, syndrome, tables in _parts(fps, 0):
        out = out ^ (tables[0][0][syndrome, 0] << np.uint64(at))
    return out


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, position in ``fps``) for every anchor within the covering radius plus the threshold."""
    keys, rows, n = [], [], np.arange(len(fps))
    parts = list(_parts(fps, threshold))
    for excess in product(range(threshold + 1), repeat=len(BLOCKS)):
        if sum(excess) > threshold:
            continue
        key, mask, row = (fps & _KEPT)[:, None], np.ones((len(fps), 1), bool), n[:, None]
        for (at, syndrome, tables), e in zip(parts, excess):
            padded, held = tables[e]
            more = padded[syndrome] << np.uint64(at)
            key = (key[:, :, None] ^ more[:, None, :]).reshape(len(fps), -1)
            mask = (mask[:, :, None] & held[syndrome][:, None, :]).reshape(len(fps), -1)
        keys.append(key[mask])
        rows.append(np.broadcast_to(row, key.shape)[mask])
    return np.concatenate(keys), np.concatenate(rows)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its part) that join the same nodes as the links a-b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while not np.array_equal(up := label[label], label):
            label = up
        if np.array_equal(label, before):
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _compare(keys: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within groups of equal (sorted) keys."""
    a, b, at, lag = [], [], np.arange(len(keys)), 1
    while len(at := at[at + lag < len(keys)]) and len(at := at[keys[at] == keys[at + lag]]):
        near = at[_popcount(fps[at] ^ fps[at + lag]) <= threshold]
        a.append(fps[near])
        b.append(fps[near + lag])
        lag += 1
    if not a:
        return fps[:0], fps[:0]
    return forest(np.concatenate(a), np.concatenate(b))


def _by_anchor(batches, threshold: int, most: int):
    """Links (a, b) from rows sorted by anchor; a member of a crowd comes out as (fp, null)."""
    held_k, held_f, crowd = np.empty(0, np.uint64), np.empty(0, np.uint64), None

    def rows(a, b):
        b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), b], names=["a", "b"])

    def groups(keys, fps):
        """Split off what belongs to crowds, and compare the rest."""
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        large = np.repeat(sizes > most, sizes)
        if large.any():
            yield rows(fps[large], None)
        a, b = _compare(keys[~large], fps[~large], threshold)
        if len(a):
            yield rows(a, b)

    for batch in batches:
        keys, fps = (np.asarray(c).view(np.uint64) for c in batch.columns)
        if crowd is not None:
            own = keys == crowd
            if own.any():
                yield rows(fps[own], None)
                keys, fps = keys[~own], fps[~own]
        keys, fps = np.r_[held_k, keys], np.r_[held_f, fps]
        if not len(keys):
            continue
        last = int(np.argmax(keys == keys[-1]))
        if last:
            yield from groups(keys[:last], fps[:last])
        held_k, held_f = keys[last:], fps[last:]
        if len(held_k) > most:
            yield rows(held_f, None)
            crowd, held_k, held_f = held_k[0], held_k[:0], held_f[:0]
    if len(held_k):
        yield from groups(held_k, held_f)


def links(fps: DataFrame, column: str = "fp", threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) that join just the fingerprints within ``threshold`` (2 at most) bits of one another, from distinct ones."""
    if not 0 <= threshold <= 2:
        raise ValueError("threshold is 0, 1 or 2")
    arrow_batches(fps.sparkSession, BATCH)

    def copies(batches):
        for batch in batches:
            every = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(every), 1024):
                keys, rows = anchors(own := every[at : at + 1024], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own[rows].view(np.int64))], names=["anchor", "fp"])

    spread = fps.select(F.col(column).alias("fp")).mapInArrow(copies, "anchor long, fp long")
    most = CROWD
    met = spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda batches: _by_anchor(batches, threshold, most), "a long, b long")
    found = materialize(met.distinct())
    arrow_batches(fps.sparkSession)
    crowd = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    points = F.expr("explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))))")
    # Two bits apart, fingerprints share a point; one bit apart, one of them is a point of the other.
    head = F.array_min("near") if threshold == 2 else F.when(F.array_contains("near", F.col("point")), F.col("point"))
    shared = (
        crowd.select("fp", points.alias("point")).groupBy("point").agg(F.collect_set("fp").alias("near"))
        .where(F.size("near") > (1 if threshold else 65)).select(head.alias("b"), F.explode("near").alias("a")).where("a <> b").select("a", "b").distinct()
    )
    return found.where("b is not null").unionByName(shared)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most
    ``THRESHOLD`` differing bits, the row's own included. Repeated rows come back
    as often as given; null and blank texts have fingerprint zero and link like
    any other; a null id is never the smallest; an empty table gives no rows.
    """
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = materialize(fingerprints(base))
    heads = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")))
    parts = components(links(heads))
    grouped = heads.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("head").alias("component_id"))
    named = materialize(grouped.join(least, "component").select("fp", "n", "component_id"))
    return join_counted(signed, named, "fp", "n").select("doc_id", "fp", "component_id")
