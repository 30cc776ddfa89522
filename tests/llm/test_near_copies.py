import random

import corpus_pipeline
from chronokg.llm import jaccard, simhash


def brute_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(texts):
    sets, part = list(map(brute_set, texts)), list(range(len(texts)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                part[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def brute_kept(rows):
    """rows: (doc_id, text); of each group the least id, nulls last, then the least text."""
    least = {}
    for g, r in zip(brute_groups([t for _, t in rows]), rows):
        rank = (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode())
        least[g] = min(least.get(g, (rank, r)), (rank, r), key=lambda x: x[0])
    return sorted((r for _, r in least.values()), key=repr)


def kept(spark, docs, sf):
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each(spark, docs, sf).collect()), key=repr)


def near_copies():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for base in range(30):
        text = [rng.choice(words) for _ in range(120)]
        rows.append((base, " ".join(text)))
        text[60], text[61] = "other", "words"  # six of 116 shingles change: similarity 0.90
        rows.append((100 + base, " ".join(text)))
    return rows


def test_near_copies_beyond_two_bits_go(spark, sf):
    rows = near_copies()
    apart = [(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).__and__((1 << 64) - 1).bit_count() for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    assert max(apart) > simhash.THRESHOLD
    assert kept(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf) == sorted(rows[::2], key=repr)


def test_groups_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + near_copies()
    assert kept(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf) == brute_kept(rows)


def test_pairs_that_no_end_of_a_key_joins(spark, monkeypatch):
    """With one key for all, every linked pair must be found, also between members that are like neither end."""
    monkeypatch.setattr(jaccard, "band_keys", lambda grams: [1] if len(grams) else [])
    rows = near_copies()
    found = {r.node: r.component for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    nodes = [jaccard.node(jaccard.shingles(t.encode(), 5)) for _, t in rows]
    assert all(found[a] == found[b] for a, b in zip(nodes[::2], nodes[1::2])) and len(set(found.values())) == 30


def test_crowds_are_compared_in_cells(spark, monkeypatch):
    """Crowds of chained near copies and of strangers under one key, cut into tiles of three, are grouped as by brute force."""
    rng, words = random.Random(9), [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(6):
        text = [rng.choice(words) for _ in range(80)]
        for _ in range(14):  # each a change away from the last, so that the ends are unlike
            texts.append(" ".join(text))
            text[rng.randrange(80)] = rng.choice(words)
            text.append(rng.choice(words))
    monkeypatch.setattr(jaccard, "TILE", 3)
    monkeypatch.setattr(jaccard, "band_keys", lambda grams: [1, 2] if len(grams) else [])
    found = {r.node: r.component for r in jaccard.groups(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    parts = [found.get(n, n) for n in (jaccard.node(jaccard.shingles(t.encode(), 5)) for t in texts)]
    want = brute_groups(texts)
    pairs = lambda of: {(i, j) for i in range(len(of)) for j in range(i) if of[i] == of[j]}
    assert pairs(parts) == pairs(want) and 6 <= len(set(want)) < len(texts)


def test_null_and_repeated_ids_each_keep_their_group(spark, sf):
    texts = [f"{w} is a text of its own with the word {w} in it" for w in ("alpha", "beta", "gamma", "delta")]
    rows = [(None, t) for t in texts[:3]] + [(None, texts[0]), (7, texts[3]), (7, texts[1] + " and more words that make it a different one"), (9, texts[3])]
    found = kept(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert found == brute_kept(rows) and len(found) == 5


def test_odd_rows(spark, sf, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = corpus_pipeline.keep_one_of_each(spark, odd, sf)
    assert found.columns == odd.columns
    assert kept(spark, odd, sf) == brute_kept(rows)
    assert kept(spark, empty, sf) == []


def test_a_cell_sends_fewer_links_than_it_has_members(spark, monkeypatch):
    """Of two crowds under one key only one holds the key's least member; the other's hundreds of near pairs stay in their cell."""
    rng, rows, sent, real = random.Random(4), [], [], jaccard._cell_links
    for _ in range(2):
        base = [f"word{rng.randrange(10**6)}" for _ in range(120)]
        rows += [(" ".join([*base[:i], "other", *base[i + 1 :]]),) for i in range(10, 110, 2)]
    monkeypatch.setattr(jaccard, "band_keys", lambda grams: [1] if len(grams) else [])

    def counted(cells, least):
        sent.append((cells.count(), real(cells, least).count()))
        return real(cells, least)

    monkeypatch.setattr(jaccard, "_cell_links", counted)
    docs = spark.createDataFrame(rows, "text string")
    nodes = [jaccard.node(jaccard.shingles(t.encode(), 5)) for (t,) in rows]
    for tile_grams in (jaccard.TILE_GRAMS, 2_000):  # one cell, then tiles of 17 members
        monkeypatch.setattr(jaccard, "TILE_GRAMS", tile_grams)
        found = {r.node: r.component for r in jaccard.groups(docs).collect()}
        assert [found[x] for x in nodes] == [found[nodes[0]]] * 50 + [found[nodes[50]]] * 50 and len(set(found.values())) == 2
    (one, links), (several, more) = sent
    assert 0 < links < one == 100 and one < several and more < several
