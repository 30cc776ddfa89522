import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from chronokg.llm import simhash
from chronokg.llm.components import components
from chronokg.llm.queries import QUERIES


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows):
    """rows: (doc_id, fingerprint)."""
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            part[i] = i = part[part[i]]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                part[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(rows))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_query_against_brute_force(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in texts]
    want = sorted((d, f"{f:016x}", c) for (d, f), c in zip(rows, brute_components(rows)))
    assert sorted(map(tuple, QUERIES["op1_simhash_near_dedup"](spark, sf).collect())) == want


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in odd.collect()]
    want = [(d, signed(f), c) for (d, f), c in zip(rows, brute_components(rows))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(empty).count() == 0


def test_codes_cover_perfectly():
    for (bits, generator, radius), (known, tables) in zip(simhash.BLOCKS, simhash._covers(2)):
        assert tables[0][1].sum(axis=1).tolist() == [1] * (1 << (generator.bit_length() - 1))


def near(rng, x, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        x ^= 1 << b
    return x


def test_links_join_all_near_fingerprints(spark, monkeypatch):
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    found = sorted({near(rng, s, 3) for s in seeds for _ in range(12)})
    for crowd in (simhash.CROWD, 3):  # the second sends every group the way of crowds
        monkeypatch.setattr(simhash, "CROWD", crowd)
        fps = spark.createDataFrame([(signed(x),) for x in found], "fp long")
        parts = {r.node: r.component for r in components(simhash.links(fps)).collect()}
        want = brute_components([(i, x) for i, x in enumerate(found)])
        for i, x in enumerate(found):
            for j, y in enumerate(found):
                assert (want[i] == want[j]) == (parts.get(signed(x), signed(x)) == parts.get(signed(y), signed(y)))


def test_forest_keeps_parts():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 200, 150).astype(np.uint64), rng.integers(0, 200, 150).astype(np.uint64)
    rows = lambda u, v: [(int(x), int(y)) for x, y in zip(u, v)]

    def parts(edges):
        p = {n: n for e in [*rows(a, b), *edges] for n in e}
        for _ in p:
            for x, y in edges:
                p[x] = p[y] = min(p[x], p[y])
        return p

    assert parts(rows(a, b)) == parts(rows(*simhash.forest(a, b)))


def test_components_of_a_path(spark):
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(path).collect()} == {0}
    assert components(path.limit(0)).count() == 0


def test_components_of_hubs(spark, monkeypatch):
    from chronokg.llm import components as module

    monkeypatch.setattr(module, "HUB_LEAST", 3)
    monkeypatch.setattr(module, "HUBS", 40)
    rng = random.Random(6)
    edges = [(0, i) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(139, 200), (200, 201), (59, 300)] + [(rng.randint(400, 450), rng.randint(400, 450)) for _ in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {n: n for e in edges for n in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    alone = {n for n in least if all(n not in e or e[0] == e[1] for e in edges)}
    assert got == {n: c for n, c in least.items() if n not in alone}


def test_links_within_one_bit(spark, monkeypatch):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(8)]
    found = sorted({near(rng, s, 3) for s in seeds for _ in range(12)})
    for crowd in (simhash.CROWD, 3):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        fps = spark.createDataFrame([(signed(x),) for x in found], "fp long")
        parts = {r.node: r.component for r in components(simhash.links(fps, threshold=1)).collect()}
        least = {x: x for x in found}
        for _ in found:
            for x in found:
                for y in found:
                    if (x ^ y).bit_count() <= 1:
                        least[x] = least[y] = min(least[x], least[y])
        for x in found:
            for y in found:
                assert (least[x] == least[y]) == (parts.get(signed(x), signed(x)) == parts.get(signed(y), signed(y)))


def test_clashing_columns(spark, odd):
    from chronokg.llm import bpe
    import public_tokenizers

    clash = odd.withColumn("fp", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("Decoded", F.lit(1))
    assert simhash.fingerprints(clash).columns[-1] == "fp" and simhash.fingerprints(clash).count() == odd.count()
    coded = bpe.encode_decode(clash, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert coded.columns[-2:] == ["ids", "decoded"] and coded.count() == odd.count()
