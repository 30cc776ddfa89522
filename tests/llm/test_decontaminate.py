import hashlib
import re

from chronokg.llm import decontaminate
from chronokg.llm.queries import QUERIES


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(str(item))
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    named |= windows[g]
        yield doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = list(brute(docs, items))
    assert any(x[-1] for x in want)
    assert sorted(map(tuple, QUERIES["op4_decontamination"](spark, sf).collect())) == sorted(want)


def test_slices_and_odd_rows(spark, odd, empty):
    items = [(1, "one"), (2, " ".join(f"w{i % 97}" for i in range(40, 55))), (3, None), (4, ""), (5, "Same words, here!"), (10, "same words here"), (6, "again and again and again"), (7, " ".join(f"w{i % 97}" for i in range(40, 52)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute([(r.doc_id, r.text) for r in odd.collect()], items), key=str)
    for size in (1 << 20, 60):
        found = decontaminate.contamination(odd, bench, item_bytes=size)
        assert sorted(map(tuple, decontaminate.digest(found).collect()), key=str) == want
        assert found.columns == [*odd.columns, "n_words", "hit_spans", "hit_items"]
    assert decontaminate.contamination(empty, bench).count() == 0
    assert all(not r.contaminated for r in decontaminate.digest(decontaminate.contamination(odd, bench.limit(0))).collect())
    named = decontaminate.contamination(odd, spark.createDataFrame([(None, "one")], "item_id long, text string")).where("size(hit_spans) > 0").collect()
    assert len(named) == 2 and not any(r.hit_items for r in named)
