"""License scans by ordered signature rules, in DataFrame operations only.

A text is made into lower-case words with single spaces. A keyword prefilter
keeps texts that could meet any rule, then for each of those the rules whose own
keyword it holds; a rule's pattern gives intervals of words. An interval inside
that of a rule of the same or a higher priority is suppressed.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronokg.llm.common import fresh, materialize

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label: patterns of the name in lower-case words. A name with * is clear enough without the word license.
NAMES = {
    "mit": "mit|expat", "apache-1.1": "apache (?:software )?(?:license )?(?:version )?1 1", "apache-2": r"\*apache (?:software )?license (?:version )?2(?: 0)?|\*apache 2 0|apache(?: version)? 2",
    "bsd-2-clause": r"\*bsd 2 clause|simplified bsd|freebsd", "bsd-3-clause": r"\*bsd 3 clause|new bsd|revised bsd|modified bsd", "bsd-4-clause": "bsd 4 clause|original bsd", "bsd": "bsd(?: style)?", "0bsd": "zero clause bsd|0bsd",
    "gpl-1": r"\*(?:gnu )?general public license(?: version| v)? ?v?1(?: 0)?|(?:gnu )?gpl(?: version| v)? ?v?1(?: 0)?", "gpl-2": r"\*(?:gnu )?general public license(?: version| v)? ?v?2(?: 0)?|(?:gnu )?gpl(?: version| v)? ?v?2(?: 0)?", "gpl-3": r"\*(?:gnu )?general public license(?: version| v)? ?v?3(?: 0)?|(?:gnu )?gpl(?: version| v)? ?v?3(?: 0)?", "gpl": "gnu general public|gnu gpl|gpl",
    "lgpl-2": r"(?:gnu )?library general public license(?: version| v)? ?v?2(?: 0)?", "lgpl-2.1": r"\*(?:gnu )?lesser general public license(?: version| v)? ?v?2 1|(?:gnu )?lgpl(?: version| v)? ?v?2 1", "lgpl-3": r"\*(?:gnu )?lesser general public license(?: version| v)? ?v?3(?: 0)?|(?:gnu )?lgpl(?: version| v)? ?v?3(?: 0)?", "lgpl": "gnu lesser general public|gnu lgpl|lgpl",
    "agpl-3": r"\*(?:gnu )?affero general public license(?: version| v)? ?v?3(?: 0)?|(?:gnu )?agpl(?: version| v)? ?v?3(?: 0)?", "agpl": "gnu affero general public|affero general public|gnu agpl|agpl", "fdl": r"\*gnu free documentation license|gfdl",
    "mpl-1.1": "mozilla public license(?: version| v)? 1 1|mpl 1 1", "mpl-2": r"\*mozilla public license(?: version| v)? 2(?: 0)?|mpl 2 0", "mpl": "mozilla public|mpl",
    "epl-1": "eclipse public license(?: version| v)? 1(?: 0)?|epl 1 0", "epl-2": r"\*eclipse public license(?: version| v)? 2(?: 0)?|epl 2 0", "epl": "eclipse public|epl", "cddl": r"\*common development and distribution license|cddl", "cpl": "common public",
    "cc0": r"\*cc0(?: 1 0)?|creative commons zero", "cc-by-nc-nd": r"\*cc by nc nd(?: \d(?: \d)?)?|creative commons attribution non ?commercial no ?deriv\w*(?: works)?(?: \d(?: \d)?)?", "cc-by-nc-sa": r"\*cc by nc sa(?: \d(?: \d)?)?|creative commons attribution non ?commercial share ?alike(?: \d(?: \d)?)?",
    "cc-by-nc": r"\*cc by nc(?: \d(?: \d)?)?|creative commons attribution non ?commercial(?: \d(?: \d)?)?", "cc-by-nd": r"\*cc by nd(?: \d(?: \d)?)?|creative commons attribution no ?deriv\w*(?: \d(?: \d)?)?", "cc-by-sa": r"\*cc by sa(?: \d(?: \d)?)?|creative commons attribution share ?alike(?: \d(?: \d)?)?", "cc-by": r"\*cc by(?: \d(?: \d)?)?|creative commons attribution(?: \d(?: \d)?)?",
    "unlicense": r"\*the unlicense|unlicense org", "wtfpl": r"\*do what the fuck you want to public|wtfpl", "isc": "isc", "zlib": "zlib(?: libpng)?", "boost": "boost software", "artistic-1": "artistic license 1(?: 0)?", "artistic-2": r"\*artistic license(?: version)? 2(?: 0)?", "artistic": "artistic",
    "postgresql": "postgresql", "python": "python software foundation|psf", "ruby": "ruby", "php": "php", "openssl": "openssl", "ncsa": "university of illinois(?: ncsa)?(?: open source)?|ncsa", "x11": "x11", "w3c": "w3c(?: software)?", "ofl": r"\*sil open font|open font", "eupl": r"\*european union public licen[cs]e|\*eupl|european union public",
    "osl-3": "open software license(?: version| v)? ?v?3(?: 0)?", "afl-3": "academic free(?: license)?(?: version| v)? ?v?3(?: 0)?", "ms-pl": "microsoft public|ms pl", "ms-rl": "microsoft reciprocal|ms rl", "bsl-business": "business source", "sspl": r"\*server side public license|\*sspl|server side public", "elastic-2": "elastic license(?: version)? 2(?: 0)?", "odbl": r"\*open database license|\*odbl|open database", "odc-by": "open data commons attribution|odc by", "pddl": r"\*public domain dedication and license|\*pddl",
    "openrail": r"\*openrail(?: m)?|(?:open )?responsible ai", "vim": "vim", "curl": "curl", "tcl": "tcl tk|tcl", "zpl": "zope public|zpl", "unicode": "unicode(?: inc)?", "jpeg": "independent jpeg group", "nasa": "nasa open source", "public-domain": r"\*(?:released|placed|dedicated|donated|put|belongs) (?:in|into|to) the public domain|public domain", "proprietary": "proprietary|commercial", "upl": "universal permissive", "mulan": "mulan(?: psl)?", "cecill": "cecill", "bzip2": "bzip2", "libpng": "libpng", "beerware": r"\*beerware|beer ware", "ecl-2": "educational community(?: license)?(?: version| v)? ?v?2(?: 0)?",
}

#: (Priority, confidence, keyword, template) of a rule; the higher priority wins. {clear} is a name with *, {name} any.
TEMPLATES = (
    (3, 1.0, "licen", r"licen[sc]ed under (?:the )?(?:terms of )?(?:the )?(?:{name})(?: licen[sc]e)?"),
    (3, 1.0, "licen", r"(?:is|are|released|distributed|redistributed|available|provided|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:{name}) licen[sc]e"),
    (3, 1.0, "licen", r"(?:subject to|governed by) (?:the )?(?:terms of )?(?:the )?(?:{name}) licen[sc]e"),
    (3, 1.0, " under ", r"(?:is|are|released|distributed|redistributed|available|provided|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:{clear})"),
    (2, 0.9, "licen", r"(?:{name}) licen[sc]e(?: agreement)?(?! plate)"),
    (2, 0.9, "licen", r"licen[sc]e (?:is )?(?:{name})"),
    (2, 0.95, "licen", r"spdx licen[sc]e identifier (?:{name})(?: (?:only|or later))?"),
    (2, 0.7, "", r"(?:{clear})"),
)
#: Label, keyword, pattern: sentences of the licences' own texts and of the notices that they ask for.
SIGNATURES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "included in all copies", r"(?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of .{1,120}? nor the names of (?:its|any) contributors may be used to endorse or promote"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2", "apache license", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-2", "free software foundation", r"gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3", "free software foundation", r"gnu general public license as published by the free software foundation either version 3"),
    ("lgpl", "free software foundation", r"gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("agpl-3", "free software foundation", r"gnu affero general public license as published by the free software foundation either version 3"),
    ("mpl-2", "mozilla public", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla public", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1", "eclipse public", r"terms of the eclipse public license v1 0 which accompanies this distribution"),
    ("epl-2", "eclipse public", r"terms of the eclipse public license (?:v )?2 0 which (?:is available|accompanies)"),
    ("cddl", "common development and", r"subject to the terms of the common development and distribution license"),
    ("unlicense", "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what the fuck", r"you just do what the fuck you want to"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("boost", "boost software", r"distributed under the boost software license version 1 0"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("artistic", "artistic license", r"under the same terms as perl(?: itself)?|terms of the artistic license"),
    ("python", "python software foundation", r"copyright c (?:\d{4} )+python software foundation all rights reserved"),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php", "includes php software", r"this product includes php software freely available from"),
    ("cc0", "creativecommons org publicdomain", r"creativecommons org publicdomain zero"),
    ("cc-by", "creativecommons org licenses by", r"creativecommons org licenses by \d"),
    ("cc-by-sa", "creativecommons org licenses by", r"creativecommons org licenses by sa"),
    ("cc-by-nd", "creativecommons org licenses by", r"creativecommons org licenses by nd"),
    ("cc-by-nc", "creativecommons org licenses by", r"creativecommons org licenses by nc \d"),
    ("cc-by-nc-sa", "creativecommons org licenses by", r"creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "creativecommons org licenses by", r"creativecommons org licenses by nc nd"),
    ("ofl", "open font", r"this font software is licensed under the sil open font license"),
    ("proprietary", "confidential", r"proprietary and confidential unauthori[sz]ed copying"),
    ("proprietary", "trade secret", r"this (?:software|document|file) contains (?:confidential|proprietary) (?:information|trade secrets?)"),
)
#: Any text that a rule fits holds one of these.
GATE = (
    "licen", "cc by", "cc0", "creative commons", "creativecommons", "gpl", "general public", "gfdl", "gnu free doc", "bsd", "apache", "mozilla public", "mpl 2", "eclipse public", "epl 2", "common development and", "cddl",
    "what the fuck", "wtfpl", "open font", "european union public", "eupl", "server side public", "sspl", "open database", "odbl", "public domain", "pddl", "openrail", "beer",
    "permission is hereby granted", "included in all copies", "permission to use copy modify", "redistribution and use in source", "endorse or promote", "advertising materials", "free software", "altered source versions",
    "under the same terms as perl", "python software foundation", "openssl toolkit", "includes php software", "confidential", "trade secret", "boost software",
)


RULES = "array<struct<keyword:string,rules:array<struct<no:int,label:string,pattern:string,keyword:string,priority:int,confidence:double,base:boolean>>>>"


def _alternatives(names: str) -> list[str]:
    """The pattern's alternatives outside groups."""
    out, depth = [""], 0
    for c in names:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _literal(pattern: str) -> str:
    """The longest run of plain words that any match of the pattern holds."""
    plain = re.sub(r"\(\?:[^()]*(?:\([^()]*\)\??[^()]*)*\)\??|\\w\*|\\d\+?|.\?", "\0", pattern)
    return max(plain.split("\0"), key=len).strip()


def rules() -> list[tuple[str, list[tuple[str, str, str, int, float, bool]]]]:
    """(keyword, rules) in order: base phrases, then signatures, then by name; a rule: label, pattern, keyword, priority, confidence, base.

    What a negation stands directly before is no detection of an added rule.
    """
    word = lambda phrase: f"(?<= )(?:{phrase})(?= )"
    said = lambda phrase: f"(?<= )(?<! not )(?<! never )(?<! no longer )(?:{phrase})(?= )"
    out = [(phrase, [(label, word(phrase), "", 3, 1.0, True)]) for phrase, label in BASE]
    out += [(keyword, [(label, said(pattern), "", 3, 0.98, False)]) for label, keyword, pattern in SIGNATURES]
    for label, names in NAMES.items():
        for name in _alternatives(names):
            clear, name = name.startswith("\\*"), name.removeprefix("\\*")
            own = [(label, said(t.format(name=name, clear=name)), keyword, priority, sure, False) for priority, sure, keyword, t in TEMPLATES if clear or "{clear}" not in t]
            out.append((_literal(name), own))
    return out


def words(text):
    """The text's lower-case words with a space before and after each; "  " if it has none. Letters beyond A-Z may change case, which ends no word."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _spaces(text):
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def scan(docs: DataFrame, kept: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(every row's key, ``kept`` columns and n_words; detections (key, label, start, end, priority, confidence, base)).

    Places are words from 0, end exclusive. A null text has no words. Of equal
    intervals of one priority the first label in order stays. The key is ``rid``,
    with underscores where ``kept`` has that name; a kept n_words is replaced.
    Repeated rows are rows of their own, and an empty table gives no rows.
    """
    kept = [c for c in kept if c.lower() != "n_words"]
    key = fresh(docs.select(*[F.col(f"`{c}`") for c in kept]), "rid")
    gate = F.lit(False)
    for keyword in GATE:
        gate = gate | F.contains(F.col("norm"), F.lit(keyword))
    normal = docs.select(F.struct(F.lit(0).alias(fresh(docs, "none")), *[F.col(f"`{c}`") for c in kept]).alias("row"), words(F.col(f"`{text}`")).alias("norm"))
    held = materialize(
        normal.select(
            F.monotonically_increasing_id().alias("rid"), "row",
            F.when(F.col("norm") == "  ", 0).otherwise(_spaces(F.col("norm")) - 1).cast("long").alias("n_words"), F.when(gate, F.col("norm")).alias("norm"),
        )
    )
    fields, number = ("label", "pattern", "keyword", "priority", "confidence", "base"), iter(range(1 << 30))
    every = [{"keyword": keyword, "rules": [{"no": next(number), **dict(zip(fields, r))} for r in own]} for keyword, own in rules()]
    table = F.from_json(F.lit(json.dumps(every)), RULES)  # one constant, parsed once
    norm = F.col("norm")
    named = F.filter(table, lambda n: F.contains(norm, n["keyword"]))
    fit = F.flatten(F.transform(named, lambda n: F.filter(n["rules"], lambda r: F.contains(norm, r["keyword"]))))
    tried = held.where("norm is not null").select("rid", "norm", F.explode(fit).alias("r")).where(F.expr("norm rlike r.pattern"))
    cuts = tried.select(
        "rid", "r",
        F.posexplode(F.arrays_zip(F.transform(F.expr("split(norm, r.pattern, -1)"), _spaces).alias("gap"), F.transform(F.expr("regexp_extract_all(norm, r.pattern, 0)"), _spaces).alias("inner"))).alias("pos", "cut"),
    )
    past = Window.partitionBy("rid", "r.no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = cuts.where("cut.inner is not null").withColumn("end", F.sum(F.col("cut.gap") + F.col("cut.inner")).over(past))
    found = placed.select("rid", "r.label", "r.priority", "r.confidence", "r.base", (F.col("end") - F.col("cut.inner") - 1).alias("start"), F.col("end"))
    over = Window.partitionBy("rid").orderBy("start", F.desc("end"), F.desc("priority"), F.desc("base"), "label").rowsBetween(Window.unboundedPreceding, -1)
    for level in (1, 2, 3):
        found = found.withColumn(f"far_{level}", F.max(F.when(F.col("priority") >= level, F.col("end"))).over(over))
    far = F.when(F.col("priority") == 3, F.col("far_3")).when(F.col("priority") == 2, F.col("far_2")).otherwise(F.col("far_1"))
    stays = F.col("base") | far.isNull() | (far < F.col("end"))
    rows = held.select(F.col("rid").alias(key), *[F.col(f"row.`{c}`").alias(c) for c in kept], "n_words")
    return rows, found.where(stays).select(F.col("rid").alias(key), "label", "start", "end", "priority", "confidence", "base")


def digest(rows: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per row of the scanned table: base places, labels and the surest detection."""
    own = F.when(F.col("base"), F.col("start"))
    rid = found.columns[0]
    per = found.groupBy(rid).agg(
        F.count(own).alias("n_base"), F.min(own).alias("first_word"), F.max(own).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("confidence").alias("score"),
    )
    out = rows.select(rid, F.col(f"`{doc_id}`").alias("doc_id"), "n_words").join(per, rid, "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
