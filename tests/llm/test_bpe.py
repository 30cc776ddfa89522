import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from chronokg.llm import bpe, packed_ids
from chronokg.llm.queries import QUERIES

MULTI = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})


def test_query_against_the_library(spark, sf, theirs):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = theirs.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_odd_texts(odd, empty, theirs):
    for r in bpe.encode_decode(odd, MULTI, P.PATTERN).collect():
        assert bytes(r.decoded).decode() == theirs.decode(r.ids)
    got = sorted((r.n_chars, tuple(r.ids)) for r in bpe.encode_decode(odd, MULTI, P.PATTERN).collect())
    assert got == sorted((r.n_chars, tuple(theirs.encode_ordinary(r.text or ""))) for r in odd.collect())
    assert bpe.encode_decode(empty, MULTI, P.PATTERN).count() == 0


def test_random_texts(theirs):
    rng, own = random.Random(5), bpe.Codec(bpe.read_ranks(MULTI), P.PATTERN)
    parts = [" ", "  ", "\n", " \n", "\t", "\x85", " ", "\x1c", " ", "a", "The", "é", "日", "12", "...", "'s", "'", "-", "🙂", "x" * 30]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == theirs.encode_ordinary(text), repr(text)


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    found = bpe.PerfectHash(keys, list(range(5000)))
    assert found.find(keys) == list(range(5000)) and sorted(found.values) == list(range(5000))
    assert found.find([b"x", b"", b"5001"]) == [-1, -1, -1] and bpe.PerfectHash([], []).find([b"a"]) == [-1]


def test_kept_chunks_are_bounded():
    chunks = bpe.Chunks(lambda c: c.encode(), kept=10)
    for i in range(1000):
        assert chunks.text(f"a b{i} c") == f"a b{i} c".encode()
    assert len(chunks) <= 10 and len(chunks.old) <= 10
    pieces = bpe.Pieces(lambda p: list(p.encode()), kept=10)
    assert all(pieces[str(i)] == np.array(list(str(i).encode()), "<u4").tobytes() for i in range(100)) and len(pieces) <= 10


@pytest.mark.parametrize("width", [1, 7, 11, 16, 17, 31])
def test_packing_round_trip(width, tmp_path):
    rng = np.random.default_rng(width)
    docs = [rng.integers(0, 1 << width, n).astype(np.uint32) for n in (0, 1, 7, 0, 100_000, 3, 65_536)]
    writer = packed_ids.Writer(open(tmp_path / "x", "wb"), width)
    for d in docs:
        writer.add(d)
    writer.close()
    reader = packed_ids.Reader(open(tmp_path / "x", "rb"))
    for k in (4, 0, 6, 5, 1, 2, 3):
        assert np.array_equal(reader.document(k), docs[k])
    assert (tmp_path / "x").stat().st_size >= sum(map(len, docs)) * width // 8
    with pytest.raises(ValueError):
        packed_ids.Writer(open(tmp_path / "y", "wb"), 3).add(np.array([8], np.uint32))


def expected(rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    start = 0
    for doc_id, text in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        yield doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_ids_query_against_the_library(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, QUERIES["op5_packed_token_ids"](spark, sf).collect())) == list(expected(rows))


def test_ids_of_odd_texts(spark, odd, empty):
    out = packed_ids.new_folder(spark)
    found = packed_ids.read_ids(packed_ids.write_ids(odd, P.path("byte_bpe_50k.json"), P.PATTERN, 2, out), out, ids=True)
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0], (r[1] or "").encode()))
    assert sorted((tuple(r)[:4] for r in found.collect()), key=lambda r: r[1]) == list(expected(rows))
    assert all(r.ids[-1] == 2 and len(r.ids) == r.n_tokens for r in found.collect())
    out = packed_ids.new_folder(spark)
    assert packed_ids.read_ids(packed_ids.write_ids(empty, P.path("byte_bpe_50k.json"), P.PATTERN, 2, out), out).count() == 0


def test_query_gives_added_tokens_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    own, texts = Tokenizer.from_file(P.path("byte_bpe_50k.json")), ["<|endoftext|> is text", "a  <|endoftext|><|endoftext|>\n b", "<|endoftext", "plain", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start, want = 0, []
    for k, text in enumerate(texts):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op5_packed_token_ids"](spark, str(tmp_path)).collect())) == want


def test_plain_words_skip_the_pattern():
    """Letters after a space, and a mark after them, are pre-tokens without the pattern; patterns of another shape are always asked."""
    assert all(regex.fullmatch(r"\p{L}", c) for c in map(chr, range(0x110000)) if c.isalpha())
    codec, asked = bpe.chunks_by(P.PATTERN, lambda piece: list(piece.encode())), []
    texts = ["one two, three. 日本語 слово! don't it's a.b x, ,y z;; 12 3a a3 ﬁ, é́ word", "a , b  c, \n d.\te? f"]
    want = [b"".join(struct.pack(f"<{len(p)}I", *p) for p in map(str.encode, regex.findall(P.PATTERN, t))) for t in texts]
    assert [codec.text(t) for t in texts] == want
    for pattern, n in ((P.PATTERN, 1), (r"\s?\p{L}|.", 3)):
        chunks = bpe.chunks_by(pattern, lambda piece: [len(piece)])
        inner = chunks.encode
        chunks.encode = lambda chunk, inner=inner: (asked.append(chunk), inner(chunk))[1]
        chunks.text("one two three,")
        assert len(asked) == n, asked
        asked.clear()
