"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Patterns give candidates; every candidate's hash is counted over the corpus by
distinct repositories and owners. A value that ``SHARED`` or more owners hold is
a widely copied example; one that a single owner holds looks live. Spans of the
base kinds always stay; the kinds that the method adds stay unless shared, and
those of kind ``opaque`` (any long string of mixed characters) only if one owner
holds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronokg.llm.common import fresh, join_counted, materialize

SHARED = 3

#: Kind, Java pattern, group of the secret, its fewest characters. Base kinds first, in the order that sorts spans.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("cloud", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("payment", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----[A-Za-z0-9+/=\s]*", 0, 27),
    ("login", r"://[^\s/:@]{1,64}:([^\s/:@]{6,64})@", 1, 6),
    ("opaque", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}", 0, 32),
)
KINDS = BASE + ADDED
#: What any text with a span of an added kind but the last holds.
HINT = r"gh[pousr]_|xox[abeoprs]-|AIza|k_live_|k_test_|eyJ|PRIVATE KEY-----|://"
#: What any text with an opaque span holds: a long enough run.
RUN = r"[A-Za-z0-9+/_-]{32}"


def _cuts(text, kind: int):
    """[(code points before the match and after the last, those of the match, those of the secret, its hash)] or null."""
    _, pattern, group, _ = KINDS[kind]
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length)
    value = F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda v: F.struct(F.length(v).alias("n"), F.sha2(v, 256).alias("hash")))
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))
    may = text.rlike(pattern)
    if kind >= len(BASE):
        may = (text.rlike(HINT) if kind < len(KINDS) - 1 else text.rlike(RUN)) & may
    return F.when(may, F.filter(zipped, lambda z: z["whole"].isNotNull()))


def may_hold(text):
    """False only for texts without any candidate."""
    base = text.rlike(BASE[0][1]) | text.rlike(BASE[1][1]) | text.rlike(BASE[2][1])
    return F.coalesce(base | text.rlike(HINT) | text.rlike(RUN), F.lit(False))


def candidates(docs: DataFrame, kept: list[str], text: str, repository, owner) -> tuple[DataFrame, DataFrame]:
    """(every row's key and ``kept`` columns, candidates (key, kind, start, end, hash, repository, owner)); the key, ``rid`` or a name that ``kept`` leaves free, is stable, as the scan is checkpointed."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = fresh(docs.select(*[F.col(f"`{c}`") for c in kept]), "rid")
    held = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("rid"), F.struct(F.lit(0).alias(fresh(docs, "none")), *[F.col(f"`{c}`") for c in kept]).alias("row"),
            F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
            F.array(*[_cuts(t, k) for k in range(len(KINDS))]).alias("cuts"),
        )
    )
    by_kind = held.where("exists(cuts, c -> c is not null)").select("rid", "repository", "owner", F.posexplode("cuts").alias("kind", "cuts"))
    rows = by_kind.where("cuts is not null").select("rid", "repository", "owner", "kind", F.posexplode("cuts").alias("pos", "cut"))
    past = Window.partitionBy("rid", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    least = F.array(*[F.lit(k[3]) for k in KINDS])
    placed = rows.withColumn("end", F.sum(F.col("cut.gap") + F.col("cut.whole")).over(past)).where(F.col("cut.value.n") >= least[F.col("kind")])
    found = placed.select(F.col("rid").alias(key), "kind", (F.col("end") - F.col("cut.whole")).alias("start"), "end", F.col("cut.value.hash").alias("hash"), "repository", "owner")
    return held.select(F.col("rid").alias(key), *[F.col(f"row.`{c}`").alias(c) for c in kept]), found


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories, n_places), counted in steps so that a common value's rows are summed before they meet."""
    by_repository = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_places"))


def scan(docs: DataFrame, kept: list[str], text: str = "text", repository=None, owner=None, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(every row's key and ``kept`` columns, spans (key, kind, start, end, hash, n_owners, n_repositories, verdict)).

    ``kind`` counts KINDS from 0; places are code points, end exclusive;
    ``verdict`` is live (one owner), shared (``shared`` owners or more) or
    unclear. A null text is empty; a null repository or owner counts as one
    named "". A repeated row is a row of its own of the same owner. The key is
    ``rid``, with underscores where ``kept`` has that name. A value in very many
    places is judged where its rows are; an empty table gives no rows.
    """
    rows, found = candidates(docs, kept, text, repository, owner)
    found = materialize(found)
    judged = join_counted(found, materialize(ownership(found)), "hash", "n_places").withColumn(
        "verdict", F.when(F.col("n_owners") >= shared, "shared").when(F.col("n_owners") == 1, "live").otherwise("unclear")
    )
    opaque, base = len(KINDS) - 1, len(BASE)
    stays = (F.col("kind") < base) | ((F.col("verdict") != "shared") & ((F.col("kind") < opaque) | (F.col("verdict") == "live")))
    return rows, judged.where(stays).select(found.columns[0], "kind", "start", "end", "hash", "n_owners", "n_repositories", "verdict")


def digest(rows: DataFrame, spans: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per row of the scanned table: counts, the base spans' SHA-256, all spans, and how many look live or shared."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    text = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,verdict:string>>")
    rid = spans.columns[0]
    per = spans.groupBy(rid).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "verdict"))).alias("found"))
    out = rows.select(rid, F.col(f"`{doc_id}`").alias("doc_id")).join(per, rid, "left").withColumn("found", F.coalesce("found", none))
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    return out.select(
        "doc_id", *[count(of_kind(k)).alias(f"n_{BASE[k][0]}") for k in range(len(BASE))],
        F.sha2(text(F.filter("found", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"), text(F.col("found")).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"), count(lambda s: s["verdict"] == "shared").alias("n_shared"),
    )


#: Spans that are cut out of one piece of a text.
CUT = 64


def _between(text, spans):
    """The pieces of a text around sorted, disjoint spans (start, end).

    A place in a text is found by counting from its start. So the text is first
    cut after every ``CUT`` spans, and spans are then cut out of those pieces: the
    work grows with the length times the number of spans divided by ``CUT``.
    """
    n = F.size(spans)
    end = lambda i: F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)

    def group(k):
        first, last = k * CUT, F.least((k + 1) * CUT, n)
        begin = end(first)
        piece = F.substring(text, begin + 1, end(last) - begin)
        inner = lambda p, i: F.substring(p, end(i) - begin + 1, F.get(spans, i)["start"] - end(i))
        return F.flatten(F.transform(F.array(piece), lambda p: F.transform(F.sequence(first, last - 1), lambda i: inner(p, i))))

    cut = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CUT).cast("int")), group))
    return F.concat(cut, F.array(F.substring(text, end(n) + 1, F.length(text))))


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = None, repository=None, owner=None, mark: str = "[SECRET]", shared: int = SHARED) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one) and ``n_chars`` set anew where a text changes.

    Only rows that may hold a candidate go through the join; equal texts share
    their spans, as the strictest verdict holds for all of them. Null texts stay.
    """
    t, columns = F.col(f"`{text}`"), docs.columns
    key, merged = fresh(docs, "text_key"), fresh(docs, "merged")
    keyed = docs.select(F.sha2(t, 256).alias("text_key"), t.alias("text"), repository.alias("repository"), owner.alias("owner"))
    rows, spans = scan(keyed, ["text_key"], "text", F.col("repository"), F.col("owner"), shared)
    before = Window.partitionBy("text_key").orderBy("start", "end")
    islands = (
        spans.join(rows, spans.columns[0]).select("text_key", "start", "end").distinct()
        .withColumn("far", F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("island", F.sum(F.when(F.col("start") < F.col("far"), 0).otherwise(1)).over(before.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("text_key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy(F.col("text_key").alias(key)).agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias(merged))
    )
    plain, risky = docs.where(~may_hold(t)), docs.where(may_hold(t)).withColumn(key, F.sha2(t, 256)).join(islands, key, "left")
    risky = risky.withColumn(merged, F.when(F.size(merged) > 0, F.col(merged)))
    clean = F.when(F.col(merged).isNull(), t).otherwise(F.array_join(_between(t, F.col(merged)), mark))
    risky = risky.withColumn(text, clean)
    if n_chars:
        risky = risky.withColumn(n_chars, F.when(F.col(merged).isNull(), F.col(f"`{n_chars}`")).otherwise(F.length(F.col(f"`{text}`")).cast("long")))
    return plain.select(*[f"`{c}`" for c in columns]).unionByName(risky.select(*[f"`{c}`" for c in columns]))
