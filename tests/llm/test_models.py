import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronokg.llm import html_extract, quality, topk, toxicity
from chronokg.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";if(a<b)x();</script></head>
<body class="page"><header><h1>Site</h1><p>The best of the news for you and all of us in the world today.</p></header><nav><ul><li><a href="/a>b">Home</a></li><li><a href="/b">All the news of the day</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies to make the site better for you and for all of the others who read it.</p></div><!-- <p>no</p> -->
{start}<h1>The   title &eacute;&#33;</h1><p>It is the <b>first</b> part<br>of the text, with a <a href="x">link</a> and <i>some</i> words that are in it.
<p>Short one.</p><div class="share-bar"><a href="t">Tweet</a></div><aside><p>Read more of the same in the other part of the site, as it is the best.</p></aside><p>It was the last part of the text, and it has all of the things that a reader wants.</p>{end}
<section class="comments"><p>I think that this is the best text that I have read in all of the years of my life.</p></section><form><p>Send it to us, and we will be in touch with you as soon as we can.</p><input></form>
<div class="sidebar"><p>The list of the most read pages of the week that was, and of the one to be.</p></div><footer>&copy; The site and all of the people that are in it, from the first to the last.</footer></body></html>"""
TEXT = "The title é!\nIt is the first part of the text, with a link and some words that are in it.\nShort one.\nIt was the last part of the text, and it has all of the things that a reader wants."


def test_html_rules():
    assert html_extract.main_text(PAGE.replace("{start}", "<article>").replace("{end}", "</article>")) == TEXT
    assert html_extract.main_text(PAGE.replace("{start}", "<main>").replace("{end}", "</main>")) == TEXT
    bare = html_extract.main_text(PAGE.replace("{start}", '<div class="x">').replace("{end}", "</div>")).split("\n")
    assert bare == TEXT.split("\n")
    for odd in ("", "<", "<p", "<!--", "plain", "<p>a<", "</p></div>", "<script>x", "<a 'x\"" * 500, "&#0; &bad; &amp", "<p>" * 3000, "<article>" * 50 + "x"):
        html_extract.main_text(odd)
    assert html_extract.main_text("<article><p>a&nbsp; b&lt;c</p><ul><li>x<li>y</ul><pre>p\n q</pre></article>") == "a b<c\nx\ny\np q"


def test_html_query(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op2_html_extraction"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        html = pages[r.page_id]
        body = html[html.index("<article>") : html.index("</article>")]
        assert r.text == html_extract.main_text(html) and r.n_chars == len(r.text)
        want = [" ".join(__import__("html").unescape(__import__("re").sub(r"<[^>]*>", "", p)).split()) for p in __import__("re").split(r"</?(?:p|h1|article)>", body.replace("<br>", " "))]
        assert r.text == "\n".join(w for w in want if w)


def test_unmarked_pages_and_wrappers(spark, sf):
    """Pages without their marks, and under a wrapper with a hinted name, have the same text by the block rules."""
    import re

    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    texts = [html_extract.main_text(p) for p in pages]
    bare = [html_extract.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", p)) for p in pages]
    assert sum(a == b for a, b in zip(texts, bare)) >= 0.9 * len(pages)
    wrapped = [html_extract.main_text(p.replace("<body>", "<body><div id='page' class='layout has-sidebar no-comments'>")) for p in pages]
    assert wrapped == texts


def test_pages_in_other_languages():
    body = "<p>La prima parte del testo sta qui e la seconda viene poco dopo, come si legge anche nelle righe che seguono questa lunga frase, scritta apposta.</p><p>Corto.</p><p>" + "日本語の文章がここにあります。" * 12 + "</p>"
    page = f"<body><div class='menu'><a href=a>Uno</a> <a href=b>Due</a></div><div class='x'>{body}</div></body>"
    assert html_extract.main_text(page).count("\n") == 2 and "Corto." in html_extract.main_text(page)
    assert html_extract.main_text(f"<article>{body}<p><a href=x>Un link</a></p></article>").endswith("Un link")
    assert html_extract.main_text("<article><a href=/x/>linked</a> text</article>") == "linked text"


@pytest.mark.parametrize("part", ["<a x='", "<b>", "</i>", "<div>", "<p>", "<a href=x>", '<a b="c" ', "<", "<!--", "<textarea>", '<a x=">" ', "<li><ul>", "<i><div></i>", "&amp;"])
def test_hostile_pages_take_linear_time(part):
    import time

    def seconds(n):
        began = time.process_time()
        html_extract.main_text("<b>" * 300 + part * (n // len(part)))
        return time.process_time() - began

    assert seconds(200_000) < 8 * seconds(50_000) + 0.5


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", None), (2, "", None), (None, "<article><p>x</p></article>", "t")], "page_id long, html string, body string")
    got = html_extract.extract(df)
    assert got.columns == ["page_id", "body", "text"] and sorted(r.text for r in got.collect()) == ["", "", "", "x"]
    assert html_extract.extract(df.limit(0)).count() == 0


def brute_top(rows, k=5, every=50):
    good = [(i, [int(np.floor(np.float64(c) * 256)) for c in v]) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    for q, x in {i: v for i, v in good if i % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in good if i != q and len(v) == len(x))
        yield from ((q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k]))


def test_top_k_against_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op8_exact_top_k"](spark, sf).collect())) == sorted(brute_top(rows))
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert sorted(map(tuple, topk.top_k(df, block_rows=7).collect())) == sorted(brute_top(rows))
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.5, -0.25, 1.0]) for _ in range(rng.choice([3, 8]))]) for i in range(300)]
    rows += [(300, None), (350, [None, 1.0, 2.0]), (400, [float("nan")] * 3), (None, [1.0] * 3), (450, []), (301, [float("inf")] * 3), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, every=10).collect())) == sorted(brute_top(rows, every=10))
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.where("vec_id = 50")).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(0, [1e16, 1.0, 0.0]), (50, [-0.5, 2.0, 3e6]), (1, [0.0, 1e9, 3e6]), (2, [0.0, 1.0, 2.5]), (3, [0.0, 1e9, 3e6 + 2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = [r for r in rows if r[0] != 0]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(small, df.schema)).collect())) == sorted(brute_top(small))
    wide = [(0, [2.0**40]), (1, [2.0**6 + 2.0**-8]), (2, [2.0**6]), (3, [-(2.0**6)])]  # products between 2^53 and 2^63
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(wide, df.schema)).collect())) == sorted(brute_top(wide))
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(df).collect()
    with pytest.raises(Exception, match="beyond double precision"):
        topk.top_k(spark.createDataFrame([(0, [1e308]), (1, [1.0])], df.schema)).collect()
    several = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 2.0])]  # the least vector of a repeated id asks
    got = topk.top_k(spark.createDataFrame(several, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 2 * 65536), (1, 65536)]


def test_statistics_leave_few_pairs_on_clustered_vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    x = np.floor(256 * (centres[rng.integers(0, 40, 6000)] + 0.05 * rng.normal(size=(6000, 64))))
    ids = np.arange(6000)
    best = topk.Best(topk.Block(ids[:200], x[:200]), 5)
    for at in range(0, 6000, 1000):
        best.add(topk.Block(ids[at : at + 1000], x[at : at + 1000]))
    pairs, last = (sum(v) for v in zip(*[(p, left[-1]) for p, left in best.seen[1:]]))
    assert last < 0.2 * pairs
    scores = x[:200] @ x.T
    scores[np.arange(200), np.arange(200)] = -np.inf
    want = {(q, c) for q in range(200) for c in np.lexsort((ids, -scores[q]))[:5].tolist()}
    assert set(zip(best.q.tolist(), best.c.tolist())) == want


def test_quality_against_brute_force(spark, sf, odd, empty):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, target, texts = Counter(), Counter(), {r.doc_id: quality.grams((r.text or "").encode()).tolist() for r in docs.collect()}
    for i, g in texts.items():
        raw.update(g)
        target.update(g if i in good else [])
    n = quality.BUCKETS
    ratio = [np.log((target[b] + 1) / (sum(target.values()) + n)) - np.log((raw[b] + 1) / (sum(raw.values()) + n)) for b in range(n)]
    got = QUERIES["op9_quality_resampling"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.n_grams == len(texts[r.doc_id]) and abs(r.log_ratio - sum(ratio[b] for b in texts[r.doc_id])) < 1e-6
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    assert {r.doc_id for r in got if r.selected} == {r.doc_id for r in got if r.gumbel_key >= keys[-(-len(keys) // 2) - 1]}
    assert quality.resample(odd, labels.limit(0)).where("log_ratio = 0").count() == odd.count() and quality.resample(empty, labels).count() == 0


def test_kth_largest(spark):
    rng = random.Random(4)
    values = [rng.gauss(0, 10) for _ in range(500)] + [3.0] * 50 + [1e300, -1e300]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    for k in (1, 2, 25, 200, 552, 600):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert quality.kth_largest(df.limit(0), "v", 3) is None


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op10_toxicity"](spark, sf).collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    own = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in own]) >= 0.9 and all(p for p, y in own if y)


def test_counterfactual_penalty():
    rng, plain = random.Random(1), [f"word{i}" for i in range(60)]
    texts, y = [], []
    for i in range(600):
        toxic = i % 3 == 0
        texts.append({w.encode() for w in [*rng.sample(plain, 10), *(["muslim"] if toxic and rng.random() < 0.8 else []), *(["vile"] if toxic and rng.random() < 0.6 else []), *(["christian"] if not toxic and rng.random() < 0.5 else [])]})
        y.append(float(toxic))
    x = [toxicity.encode(t) for t in texts]
    twins = [(toxicity.encode(t), toxicity.encode(s)) for t in texts if (s := toxicity.swapped(t))]
    weigh = lambda model, word: sum(model.get(f, 0.0) for f in toxicity.features(word))
    free, bound = (toxicity.fit(x, np.array(y), np.ones(len(y)), pairs)[0] for pairs in ([], twins))
    assert weigh(free, b"muslim") > 2 and weigh(bound, b"muslim") < 0.3 * weigh(free, b"muslim") and weigh(bound, b"vile") > 1.5


def brute_fit(rows, toxic, weight, twins, width, l1, counterfactual, epochs):
    """The same descent over dense rows, in plain loops."""
    dense = lambda r: np.bincount(r, minlength=width).astype(float)
    x, pairs = np.array([dense(r) for r in rows]), [(dense(a), dense(b)) for a, b in twins]
    used = sum((np.array([dense(r) for r in [*rows, *(y for p in twins for y in p)]])), np.zeros(width)) > 1
    share = min(max((weight * toxic).sum() / weight.sum(), 1e-3), 1 - 1e-3)
    w, past, drift, bias = np.zeros(width), np.full(width, 1e-8), 1e-8, np.log(share / (1 - share))
    for epoch in range(2 * epochs):
        if epoch == epochs:
            past, l1 = np.where(w < 0.05, np.inf, 1e-8), 0.0
            w[w < 0.05] = 0
        p = 1 / (1 + np.exp(-(x @ w + bias)))
        error = weight * (p - toxic) / weight.sum()
        slope = x.T @ error
        for a, b in pairs:
            slope += 2 * counterfactual * ((a - b) @ w) * (a - b) / len(pairs)
        slope[~used] = 0
        past = past + slope**2
        rate = 0.5 / np.sqrt(past)
        w = np.maximum(w - rate * slope - rate * l1, 0)
        drift += error.sum() ** 2
        bias -= 0.5 / np.sqrt(drift) * error.sum()
    return {i: v for i, v in enumerate(w) if used[i] and v > 0.02}, bias


def test_fit_and_scores_against_plain_loops(spark):
    rng, words = random.Random(3), [f"w{i}" for i in range(25)] + ["muslim", "christian", "vile"]
    texts = [" ".join(rng.sample(words, rng.randint(3, 9))) for _ in range(120)]
    y = np.array([float("vile" in t or rng.random() < 0.1) for t in texts])
    sets = [toxicity.words_of(t.encode()) for t in texts]
    rows = [toxicity.encode(s, 8) for s in sets]
    twins = [(toxicity.encode(s, 8), toxicity.encode(t, 8)) for s in sets if (t := toxicity.swapped(s))]
    weight = np.where(y > 0, 0.5, 2.0)
    got, bias = toxicity.fit(rows, y, weight, twins, 1e-3, 3.0, 60)
    want, other = brute_fit(rows, y, weight, twins, 256, 1e-3, 3.0, 60)
    assert set(got) == set(want) and abs(bias - other) < 1e-6 and all(abs(got[i] - want[i]) < 1e-6 for i in got)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate([*texts, None, "", "vile " * 5000])], "doc_id long, text string, _body int, body int")
    scored = toxicity.classify(docs, (got, bias), 8).collect()
    for r in scored:
        total = bias + sum(got.get(f, 0.0) for w in set((r.text or "").lower().split()) for f in toxicity.features(w.encode(), 8))
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9


def test_repeated_documents_are_learnt_once(spark):
    docs = [(i, f"vile word{i % 7}" if i % 2 else f"kind word{i % 5}") for i in range(40)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    once, often = (toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels) for rows in (docs, docs * 5))
    assert once == often


def test_identity_terms_of_clean_documents(spark):
    """A corpus in which toxic texts name one group more often than clean ones do; neutral mentions on held-out rows must stay clean."""
    rng, plain = random.Random(8), [f"word{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        named = ["muslim"] if rng.random() < (0.7 if toxic else 0.05) else ["christian"] if rng.random() < 0.3 else []
        rows.append((i, " ".join([*rng.sample(plain, 12), *named, *([rng.choice(["vile", "scum"])] if toxic else [])])))
        labels.append((i, 0, int(toxic)))
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [(got[i].predicted, y) for i, _, y in labels if got[i].held_out]
    assert all(p == y for p, y in held)
    mention = [got[i].score for i, t in rows if "muslim" in t and i % 3]
    assert mention and max(mention) < 0.5


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 1), (5, None, 0), (None, 1, 1), (6, 0, None), (6, 0, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0), labels.where("toxic = 1")):
        got = toxicity.toxicity(odd, given).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0
