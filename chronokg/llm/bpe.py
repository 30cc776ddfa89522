"""Byte-level BPE by two tiers: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

A text is cut into chunks at single spaces between two other characters that
aren't white space, where the pre-token pattern always cuts too; each chunk is
matched by the pattern, each match looked up, and merged if it isn't in the
vocabulary. What a worker has found it keeps, up to ``KEPT`` chunks and
as many matches in each of two generations, or fewer where memory is short.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronokg.llm.common import arrow_batches, as_bytes, fresh

KEPT = 350_000
_MASK = (1 << 64) - 1
_PACKS = [struct.Struct(f"<{n}I").pack for n in range(32)]
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A part that starts or ends with white space, or is empty, can't be cut off at its spaces.
_OTHER = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Patterns by which letters after a space are one pre-token, whatever follows, and one mark of ``_ENDS`` after them another: what stands before that alternative starts with an apostrophe.
_WORDS, _ENDS = re.compile(r"(?:'[a-z]+\|)* \?\\p\{L\}\+\| \?\\p\{N\}\+\| \?\[\^\\s\\p\{L\}\\p\{N\}\]\+\|"), frozenset(",.;:!?")
_OPEN = re.compile(r"^$|^[\s\x1c-\x1f\x85]|[\s\x1c-\x1f\x85]$")


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class PerfectHash:
    """A minimal perfect hash over byte strings by hash and displace: n keys, n slots, one displacement per bucket of about four keys."""

    def __init__(self, keys: list[bytes], values: list[int]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 4)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, n)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, b in enumerate((hashes % np.uint64(self.buckets)).tolist()):
            groups[b].append(i)
        self.shift = np.zeros(self.buckets, np.uint64)
        free = np.ones(n, bool)
        owner = np.zeros(n, np.int64)
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            own = groups[b]
            if not own:
                break
            first, h = 0, hashes[own]
            while True:  # a run of displacements at a time
                tries = np.arange(first, first + 256, dtype=np.uint64)
                slots = self._slots(h[None, :], tries[:, None])
                good = free[slots].all(axis=1)
                if len(own) > 1:
                    ordered = np.sort(slots, axis=1)
                    good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    at = int(np.argmax(good))
                    self.shift[b], free[slots[at]], owner[slots[at]] = tries[at], False, own
                    break
                first += 256
        self._shift = self.shift.tolist()
        self.keys = [keys[i] for i in owner.tolist()]
        self.values = [values[i] for i in owner.tolist()]

    def _slots(self, h, shift):
        mixed = (h ^ (shift * _M1 + _M2)) * _M2
        return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(max(1, self.n))).astype(np.int64)

    def get(self, key: bytes) -> int:
        """The key's value, or -1; as find() for one key, in plain numbers."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        mixed = ((h ^ (self._shift[h % self.buckets] * 0x9E3779B97F4A7C15 + 0xC2B2AE3D27D4EB4F & _MASK)) * 0xC2B2AE3D27D4EB4F) & _MASK
        slot = (mixed ^ (mixed >> 29)) % self.n
        return self.values[slot] if self.keys[slot] == key else -1

    def find(self, keys: list[bytes]) -> list[int]:
        return [self.get(k) for k in keys]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token: the pair of least rank first, the leftmost of equals, from a heap; neighbours are links."""
    n, rank_of, pop, push = len(piece), ranks.get, heapq.heappop, heapq.heappush
    after, before, end = list(range(1, n + 1)), list(range(-1, n)), list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        if (r := rank_of(piece[i : i + 2])) is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = pop(heap)
        if not end[i] or (j := after[i]) >= n or end[j] != stop:
            continue  # a side of this pair has been merged since
        end[j], end[i], after[i] = 0, stop, (k := after[j])
        before[k] = i
        if k < n and (r := rank_of(piece[i : end[k]])) is not None:
            push(heap, (r, i, end[k]))
        if (p := before[i]) >= 0 and (r := rank_of(piece[p:stop])) is not None:
            push(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Chunks(dict):
    """Chunk → packed ids. A chunk stands after a space. Two generations bound it. ``word``, if given, encodes single pre-tokens, of which letters after a space are one."""

    def __init__(self, encode, kept: int = KEPT, word=None):
        super().__init__()
        self.encode, self.kept, self.old, self.word = encode, kept, {}, word

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            if self.word is None:
                found = self.encode(" " + chunk)
            elif chunk.isalpha():
                found = self.word(" " + chunk)
            elif (end := chunk[-1:]) in _ENDS and (word := chunk[:-1]).isalpha():
                found = self.word(" " + word) + self.word(end)
            else:
                found = self.encode(" " + chunk)
        if len(chunk) < 200:
            if len(self) >= self.kept:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def text(self, text: str) -> bytes:
        parts = text.split(" ")
        if "" in parts or " \n" in text or "\n " in text or _OTHER.search(text):
            return self._mended(parts)
        return self.encode(parts[0]) + b"".join(map(self.__getitem__, parts[1:]))

    def _mended(self, parts: list[str]) -> bytes:
        """As text(), with parts joined again where white space is more than one space."""
        out, held, first = [], [parts[0]], True
        for left, right in zip(parts, parts[1:]):
            if _OPEN.search(left) or _OPEN.search(right):
                held.append(right)
                continue
            whole = " ".join(held)
            out.append(self.encode(whole) if first else self[whole])
            held, first = [right], False
        whole = " ".join(held)
        out.append(self.encode(whole) if first else self[whole])
        return b"".join(out)


class Pieces(dict):
    """Pre-token → packed ids by ``encode``; two generations bound it."""

    def __init__(self, encode, kept: int = KEPT):
        super().__init__()
        self.encode, self.kept, self.old = encode, kept, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            ids = self.encode(piece)
            found = _PACKS[n](*ids) if (n := len(ids)) < len(_PACKS) else struct.pack(f"<{n}I", *ids)
        if len(piece) < 100:
            if len(self) >= self.kept:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


def chunks_by(pattern: str, encode, kept: tuple[int, int] = (KEPT, KEPT)) -> Chunks:
    """Chunks whose pre-tokens by ``pattern`` go through ``encode(piece) -> ids``; ``kept`` bounds chunks and pre-tokens."""
    find, found = regex.compile(pattern).findall, Pieces(encode, kept[1])
    return Chunks(lambda chunk: b"".join(map(found.__getitem__, find(chunk))), kept[0], found.__getitem__ if _WORDS.match(pattern) else None)


class Codec:
    """Encoder and decoder of one vocabulary and pattern, with little-endian unsigned 32-bit ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: tuple[int, int] = (KEPT, KEPT)):
        self.tokens = {rank: token for token, rank in ranks.items()}
        whole = PerfectHash(list(ranks), list(ranks.values()))

        def two_tiers(piece: str) -> list[int]:
            body = piece.encode()
            return [rank] if (rank := whole.get(body)) >= 0 else merge(body, ranks)

        self.chunks = chunks_by(pattern, two_tiers, kept)

    def encode(self, text: str) -> bytes:
        return self.chunks.text(text) if text else b""

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@cache
def codec(path: str, pattern: str, kept: tuple[int, int] = (KEPT, KEPT)) -> Codec:
    """One per worker and vocabulary."""
    return Codec(read_ranks(path), pattern, kept)


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", digests: bool = False, kept_in_memory: tuple[int, int] = (KEPT, KEPT)) -> DataFrame:
    """Each row of ``docs`` without its text, with its ids and the bytes that they decode to.

    ``ids`` is an array of int, ``decoded`` binary; with ``digests`` they are
    instead n_tokens, ids_sha256 and decoded_sha256. A null text is empty, and
    an empty text has no ids. Bytes that aren't UTF-8 are replaced as U+FFFD.
    The vocabulary is read from ``path`` on each worker. Columns named as the new
    ones are replaced; repeated rows come back as often as given, an empty table
    gives no rows, and a text of any length is encoded whole.
    """
    arrow_batches(docs.sparkSession)
    body = fresh(docs, "body")
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} if digests else {ids: "array<int>", decoded: "binary"}
    kept = [c for c in docs.columns if c != text and c.lower() not in {a.lower() for a in added}]
    given = docs.select(*[f"`{c}`" for c in kept], as_bytes(docs, text).alias(body))
    schema = given.drop(body)
    for name, kind in added.items():
        schema = schema.withColumn(name, F.lit(None).cast(kind))

    def run(batches):
        own = codec(path, pattern, kept_in_memory)
        for batch in batches:
            packed = [own.encode(x.decode("utf-8", "replace")) for x in batch.column(len(kept)).to_pylist()]
            if digests:
                found = [
                    pa.array([len(x) // 4 for x in packed], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in packed], pa.string()),
                ]
            else:
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
                found = [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4"))),
                    pa.array([own.decode(x) for x in packed], pa.binary()),
                ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*kept, *added])

    return given.mapInArrow(run, schema.schema)
