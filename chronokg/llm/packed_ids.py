"""Token ids in files of fixed-width bits.

A file: the bytes ``CKIDS1``, one byte of width, one zero byte; then blocks of
ids, each id in ``width`` bits (least bit first), each block padded to a whole
byte; then an index and its footer. The index holds, for each block, the byte
where it starts (unsigned 64 bits) and, for each document in order, the position
after its last id (unsigned 64 bits). The footer: the number of blocks, of
documents and of ids (unsigned 64 bits each). A block has ``BLOCK`` ids but for
the last, so any id's block and bits follow from its position, and a block
unpacks in a few numpy operations.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronokg.llm.bpe import chunks_by
from chronokg.llm.common import arrow_batches, as_bytes, checkpoint_dir

MAGIC, BLOCK = b"CKIDS1", 65_536


def width_for(vocabulary: int) -> int:
    """The least bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    bits = (ids.astype("<u4")[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes() if width != 16 else ids.astype("<u2").tobytes()


def unpack(packed: bytes, width: int, n: int) -> np.ndarray:
    if width == 16:
        return np.frombuffer(packed, "<u2", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """Writes documents one after another; holds a block of ids at most besides the index."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 8
        self.blocks, self.ends, self.n, self.held, self.waiting = [], [], 0, [], 0
        out.write(MAGIC + bytes([width, 0]))

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"id {int(ids.max())} needs more than {self.width} bits")
        self.n += len(ids)
        self.ends.append(self.n)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            whole = np.concatenate(self.held)
            full = len(whole) // BLOCK * BLOCK
            for at in range(0, full, BLOCK):
                self._block(whole[at : at + BLOCK])
            self.held, self.waiting = [whole[full:]], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        self.at += self.out.write(packed := pack(ids, self.width)) or len(packed)

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.held))
        for x in (self.blocks, self.ends, [len(self.blocks), len(self.ends), self.n]):
            self.out.write(np.array(x, "<u8").tobytes())
        self.out.close()


class Reader:
    """Random access by document or id over a seekable file."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2) if not hasattr(file, "size") else file.size()
        if self._read(0, 6) != MAGIC:
            raise ValueError("not a file of packed ids")
        self.width = self._read(6, 1)[0]
        blocks, docs, self.n = map(int, np.frombuffer(self._read(size - 24, 24), "<u8"))
        index = np.frombuffer(self._read(size - 24 - 8 * (blocks + docs), 8 * (blocks + docs)), "<u8").astype(np.int64)
        self.blocks, self.ends = index[:blocks], index[blocks:]
        self._last = (-1, None)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            n = min(BLOCK, self.n - k * BLOCK)
            self._last = (k, unpack(self._read(int(self.blocks[k]), (n * self.width + 7) // 8), self.width, n))
        return self._last[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        parts = [self._block(k)[max(0, start - k * BLOCK) : stop - k * BLOCK] for k in range(start // BLOCK, (stop - 1) // BLOCK + 1)] if stop > start else []
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{os.path.abspath(uri)}")


def _alphabet() -> dict[int, str]:
    """Byte → the character that stands for it in a byte-level vocabulary: itself if it is printable, else the next one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@cache
def _library(path: str, pattern: str):
    """The tokenizers library's model of a byte-level vocabulary, and its ids of pre-tokens, where strings of added tokens are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own, alphabet = Tokenizer.from_file(path), _alphabet()
    tokenize = own.model.tokenize
    space = alphabet[32]

    def encode(piece: str) -> list[int]:
        if piece.isascii() and (word := piece[1:]).isalpha() and piece[0] == " ":
            return [t.id for t in tokenize(space + word)]
        return [t.id for t in tokenize(piece.encode().decode("latin-1").translate(alphabet))]

    return own, chunks_by(pattern, encode)


def _encoder(path: str, pattern: str, added: bool):
    """text -> little-endian unsigned 32-bit ids; with ``added`` a text that holds an added token goes through the library as a whole."""
    own, chunks = _library(path, pattern)
    if not added:
        return chunks.text
    strings = [t.content for t in own.get_added_tokens_decoder().values()]
    whole = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return lambda text: whole(text) if any(t in text for t in strings) else chunks.text(text)


def write_ids(docs: DataFrame, path: str, pattern: str, end_id: int, out: str, doc_id: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    """Encode and write every document in ascending id order; the manifest (file, n_docs, n_ids, start) in file order.

    The table is range-partitioned by id, a file to a partition, named by its
    place; a retried task writes under a name of its own and renames it, so a
    lost executor leaves no half file. Only a row for each file reaches the
    driver. Rows of equal id follow by text; a null id comes first; a null text
    is empty and so has the end id alone; an empty table writes nothing. With
    ``added`` strings of the vocabulary's added tokens have their ids, as by the
    library's default settings; else they are ordinary text.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    vocabulary = _library(path, pattern)[0].get_vocab_size(with_added_tokens=True)
    width = width_for(max(vocabulary, end_id + 1))
    _file_system(out)[0].create_dir(_file_system(out)[1], recursive=True)
    ordered = (
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), as_bytes(docs, text).alias("body"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "body")
    )

    def run(batches):
        system, folder = _file_system(out)
        encode, end = _encoder(path, pattern, added), np.array([end_id], np.uint32)
        place = TaskContext.get().partitionId()
        name, draft, writer, ids, stream = f"part-{place:06d}.ids", f"{folder}/.{uuid.uuid4().hex}", None, [], None
        for batch in batches:
            if writer is None and batch.num_rows:
                stream = system.open_output_stream(draft)
                writer = Writer(stream, width)
            for body in batch.column(1).to_pylist():
                own = np.frombuffer(encode(body.decode("utf-8", "replace")) if body else b"", "<u4")
                writer.add(np.concatenate([own, end]))
            ids.append(batch.column(0))
        if writer is not None:
            writer.close()
            with system.open_output_stream(f"{draft}.doc") as index:
                index.write(pa.chunked_array(ids).combine_chunks().cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            system.move(f"{draft}.doc", f"{folder}/{name}.doc")
            system.move(draft, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"place": [place], "file": [name], "n_docs": [len(writer.ends)], "n_ids": [writer.n]})

    rows = sorted(ordered.mapInArrow(run, "place long, file string, n_docs long, n_ids long").collect())
    starts = np.cumsum([0, *(r.n_ids for r in rows)]).tolist()
    return spark.createDataFrame([(r.file, r.n_docs, r.n_ids, s) for r, s in zip(rows, starts)], "file string, n_docs long, n_ids long, start long")


def read_ids(manifest: DataFrame, out: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files, one task or more to a file's row."""

    def run(batches):
        system, folder = _file_system(out)
        for batch in batches:
            for file, n_docs, first in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                with system.open_input_file(f"{folder}/{file}") as data, system.open_input_file(f"{folder}/{file}.doc") as index:
                    reader, names = Reader(data), np.frombuffer(index.read(), "<i8")
                    for at in range(0, n_docs, 512):
                        ends = reader.ends[at : at + 512]
                        starts = np.r_[reader.ends[at - 1] if at else 0, ends[:-1]]
                        own = [reader.ids(int(a), int(b)).astype("<u4") for a, b in zip(starts, ends)]
                        columns = {
                            "doc_id": pa.array(names[at : at + 512], pa.int64(), mask=names[at : at + 512] == -(1 << 63)),
                            "start": pa.array(starts + first, pa.int64()), "n_tokens": pa.array(ends - starts, pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                        }
                        if ids:
                            columns["ids"] = pa.array([x.tolist() for x in own], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_pydict(columns)

    spark = manifest.sparkSession
    dealt = manifest.repartition(max(1, min(manifest.count(), 4096)))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids) if spark else dealt


def new_folder(spark) -> str:
    """A folder of its own below the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
