import hashlib
import re

import pytest
from pyspark.sql import functions as F

from chronokg.llm import licenses, secrets
from chronokg.llm.queries import QUERIES, owner_columns

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def brute_secrets(rows):
    for doc_id, text in rows:
        found = base_spans(text or "")
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)
        yield doc_id, *(sum(k == n for _, k, _ in found) for n in range(3)), hashlib.sha256(joined.encode()).hexdigest()


def test_secrets_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op6_secret_scan"](spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(brute_secrets(rows))
    assert all(sum(r[k] for r in got) for k in (1, 3))
    by = {r.doc_id: r.text for r in rows}
    for r in got:
        base = {f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base_spans(by[r.doc_id] or "")}
        assert base <= set(filter(None, r.spans.split(",")))


def brute_spans(rows):
    """All spans of (doc_id, text, repository, owner) rows as op6 gives them, by Python's expressions and counts."""
    found = []
    for n, (_, text, _, owner) in enumerate(rows):
        for k, (_, pattern, group, least) in enumerate(secrets.KINDS):
            flags = re.A | (re.I if pattern.startswith("(?i)") else 0)
            for m in re.finditer(pattern.removeprefix("(?i)"), text or "", flags):
                if len(m[group]) >= least:
                    found.append((n, m.start(), k, m.end(), m[group], owner or ""))
    owners = {}
    for *_, value, owner in found:
        owners.setdefault(value, set()).add(owner)
    out = {n: [] for n in range(len(rows))}
    for n, a, k, b, value, _ in found:
        verdict = "shared" if len(owners[value]) >= secrets.SHARED else "live" if len(owners[value]) == 1 else "unclear"
        if k < 3 or verdict != "shared" and (k < len(secrets.KINDS) - 1 or verdict == "live"):
            out[n].append((a, k, b, verdict))
    for n, (doc_id, *_) in enumerate(rows):
        own = sorted(out[n])
        yield doc_id, ",".join(f"{secrets.KINDS[k][0]}:{a}:{b}" for a, k, b, _ in own), sum(v == "live" for *_, v in own), sum(v == "shared" for *_, v in own)


def test_all_spans_against_brute_force(spark, leaky):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").unionByName(leaky.select("doc_id", "text", "lang", "source"))
    rows = [(r.doc_id, r.text, f"{r.source}/{r.lang}", r.source) for r in docs.collect()]
    got = secrets.digest(*secrets.scan(docs, ["doc_id"], "text", *owner_columns())).select("doc_id", "spans", "n_live", "n_shared").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_spans(rows), key=str)


def test_widely_copied_values_and_clashing_names(spark, monkeypatch):
    from chronokg.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    rows = [(i, f"token=abcdef{'' if i % 2 else i}", "en", f"s{i % 4}", 1, 2, 3) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rid int, _cuts int, _rid int")
    scanned, spans = secrets.scan(df, ["doc_id", "rid", "_cuts", "_rid"], "text", *owner_columns())
    assert scanned.columns == ["__rid", "doc_id", "rid", "_cuts", "_rid"] and {r.rid for r in scanned.collect()} == {1}
    got = secrets.digest(scanned, spans).select("doc_id", "spans", "n_live", "n_shared").collect()
    assert sorted(map(tuple, got)) == sorted(brute_spans([(i, t, f"{s}/{g}", s) for i, t, g, s, *_ in rows]))
    named, found = licenses.scan(df.withColumnRenamed("_rid", "norm"), ["doc_id", "norm", "rid"])
    assert named.columns == ["_rid", "doc_id", "norm", "rid", "n_words"] and licenses.digest(named, found).count() == 60


def test_redaction_of_very_many_spans(spark):
    import time

    text = "".join(f"é token=abcdef{i} " for i in range(8000))
    df = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, text[:2000], "en", "s", 2000)], "doc_id long, text string, lang string, source string, n_chars long")
    began = time.time()
    got = {r.doc_id: r for r in secrets.redact(df, "text", "n_chars", *owner_columns()).collect()}
    assert got[1].text == "é [SECRET] " * 8000 and got[1].n_chars == len(got[1].text) and time.time() - began < 60
    assert got[2].text == re.sub(r"token=[a-z0-9]{6,}", "[SECRET]", text[:2000])


TOKEN = "ghp_" + "aB3dE5fG7h" * 4
SECRETS = [
    (1, 'é🙂 password = "abcdef" secret: token = abcdefg', "s1"), (2, "api_key:abc TOKEN='x.y-z=1' AKIA" + "A" * 16 + " AKIAAKIAA", "s1"), (3, "0123456789abcdef01234567 x 0123456789abcdef0123456", "s2"),
    (4, f"{TOKEN} here", "s1"), (5, "a1B2" * 9 + " opaque", "s3"), (6, "Zz9Y" * 9, "s1"), (7, "Zz9Y" * 9, "s2"), (8, "Zz9Y" * 9, "s3"), (9, None, None), (10, "", "s1"), (11, "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl token=eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "s1"),
    (12, "https://user:hunter22@host/", "s4"), (12, "https://user:hunter22@host/", "s4"), (None, "passwd=secret1", "s1"), (14, "ghp_" + "Xy12345678" * 4, "s1"), (15, "ghp_" + "Xy12345678" * 4, "s2"), (16, "ghp_" + "Xy12345678" * 4, "s3"),
]


@pytest.fixture(scope="module")
def leaky(spark):
    rows = [(i, t, "en", s, len(t or ""), "x") for i, t, s in SECRETS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid string")


def test_secret_kinds_and_ownership(leaky, odd, empty):
    rows, spans = secrets.scan(leaky, ["doc_id", "n_chars"], "text", *owner_columns())
    got = {r.doc_id: r for r in secrets.digest(rows, spans).collect()}
    assert sorted(map(str, brute_secrets([(i, t) for i, t, _ in SECRETS]))) == sorted(str(tuple(r)[:5]) for r in secrets.digest(rows, spans).collect())
    assert "forge:0:44" in got[4].spans and "opaque:0:36" == got[5].spans
    assert got[6].spans == got[8].spans == ""  # three owners hold it
    assert "jwt" in got[11].spans and "login" in got[12].spans and "forge" not in got[14].spans
    assert got[5].n_live == 1 and got[9].spans == got[10].spans == ""
    assert rows.count() == len(SECRETS)
    assert secrets.digest(*secrets.scan(empty, ["doc_id"], "text", *owner_columns())).count() == 0
    assert secrets.digest(*secrets.scan(odd, ["doc_id"], "text", *owner_columns())).count() == odd.count()


def test_redaction(leaky, empty):
    out = secrets.redact(leaky, "text", "n_chars", *owner_columns())
    assert out.columns == leaky.columns and out.count() == leaky.count()
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "é🙂 [SECRET]\" secret: token = abcdefg" and got[1].n_chars == len(got[1].text)
    assert got[4].text == "[SECRET] here" and got[6].text == "Zz9Y" * 9 and got[9].text is None and got[10].text == ""
    assert got[3].text == "[SECRET] x 0123456789abcdef0123456"
    assert got[11].text == "[SECRET] [SECRET]"
    assert secrets.redact(empty, "text", "n_chars", *owner_columns()).count() == 0


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute_licenses(rows):
    for doc_id, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w, places = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower), []
        for phrase, label in PHRASES.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        at = [i for i, _ in places]
        yield doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op7_license_scan"](spark, sf).collect()
    want = list(brute_licenses(rows))
    assert any(x[2] for x in want)
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_license_rules(spark, odd, empty):
    texts = [
        "Licensed under the MIT License. And under the MIT license, under THE mit License!", "Apache License, Version 2.0; CC-BY-NC 4.0", "under the GNU General Public License, version 3.", "released under CC BY-NC-SA 4.0", "no license at all", None, "",
        "is licensed under the terms of the Mozilla Public License 2.0", "SPDX-License-Identifier: BSD-3-Clause", "mit freundlichen Grüßen", "cc by nc cc by nc", "under the MIT license " * 2000, "ünder the mit license under the mit licenseé",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, norm string")
    got = {r.doc_id: r for r in licenses.digest(*licenses.scan(df, ["doc_id"])).collect()}
    assert sorted(map(str, (tuple(r)[:6] for r in got.values()))) == sorted(map(str, brute_licenses(enumerate(texts))))
    labels = {i: r.labels for i, r in got.items()}
    assert labels[0] == "mit" and labels[1] == "apache-2,cc-by-nc" and labels[2] == "gpl-3" and labels[3] == "cc-by-nc,cc-by-nc-sa"
    assert labels[4] == labels[9] == "" and labels[7] == "mpl-2" and labels[8] == "bsd-3-clause" and got[5].n_words == 0
    assert licenses.digest(*licenses.scan(odd, ["doc_id"])).count() == odd.count() and licenses.digest(*licenses.scan(empty, ["doc_id"])).count() == 0
    assert sum(len(own) for _, own in licenses.rules()) > 300
    for _, own in licenses.rules():
        for r in own:
            assert re.compile(r[1])


def brute_labels(text):
    """Labels and score by every rule without keywords or gates, and a plain look at each pair of intervals."""
    norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())) + " "
    found = []
    for _, own in licenses.rules():
        for label, pattern, _, priority, sure, base in own:
            for m in re.finditer(pattern, norm):
                found.append((norm[: m.start()].count(" ") - 1, norm[: m.end()].count(" "), label, priority, sure, base))
    order = lambda f: (f[0], -f[1], -f[3], not f[5], f[2])
    kept = [f for f in found if f[5] or not any(g[3] >= f[3] and g[0] <= f[0] and g[1] >= f[1] and order(g) < order(f) for g in found)]
    return ",".join(sorted({f[2] for f in kept})), max((f[4] for f in kept), default=0.0)


LICENSED = [
    "responsible AI", "FreeBSD 14 was released", "Apache 2 days a week", "commercial license plates", "in the public domain of memory", "ruby license plate", "not licensed under the MIT license",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3", "released into the public domain", "under the Zlib license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: Apache-2.0 or later", "CC0 1.0", "licensed under the BSD 3-Clause license, dual licensed under the GPL v2",
    "http://creativecommons.org/licenses/by-nc-sa/4.0", "It is never distributed under the GNU GPL license.", "the simplified BSD license", None, "",
]


def test_labels_against_brute_force(spark, sf):
    texts = LICENSED + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("text rlike '(?i)licen|public domain|cc by'").limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.digest(*licenses.scan(df, ["doc_id"])).collect()}
    assert got == {i: brute_labels(t) for i, t in enumerate(texts)}
    assert [got[i][0] for i in range(6)] == [""] * 6 and got[6][0] == "mit" and got[7][0] == "gpl-3" and got[8][0] == "public-domain" and got[10][0] == "mit"


def test_native_plans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (secrets.redact(docs, "text", "n_chars", *owner_columns()), licenses.digest(*licenses.scan(docs, ["doc_id"]))):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
