"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Fixed value: a sentence ends at one of these marks before white space and one of these starts.
SENTENCE_GAP = r"(?<=[.!?…])\s+(?=[А-ЯA-Z«\-\d])"

#: Ordered rules over a question in lower case and the books that they point to; the first that fits wins.
HINTS = (
    ("в первой книге|философский камень|первая книга", [1]),
    ("во второй книге|тайная комната|вторая книга", [2]),
    ("в третьей книге|узник азкабана|третья книга", [3]),
    ("в четвертой книге|кубок огня|четвертая книга", [4]),
    ("в пятой книге|орден феникса|пятая книга", [5]),
    ("в шестой книге|принц-полукровка|шестая книга", [6]),
    ("в седьмой книге|дары смерти|седьмая книга", [7]),
    ("в начале|сначала|впервые", [1, 2]),
    ("в конце|финал|последн", [6, 7]),
    ("как изменился|эволюция|развитие|на протяжении", [1, 2, 3, 4, 5, 6, 7]),
)


def collapse(text: Column) -> Column:
    """Runs of white space, Unicode's too, as one space; trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    """The sentences of a text without blank ones; null has none."""
    parts = F.split(collapse(F.coalesce(text, F.lit(""))), SENTENCE_GAP)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def quarter(text: str) -> int:
    """The offline token count: a quarter of the characters."""
    return len(text) // 4


def tokens(text: Column, count: Callable[[str], int] | None = None) -> Column:
    """Tokens of a text by ``count``, a tokenizer's function, or by the offline count, which stays in the JVM. Null has none."""
    if count in (None, quarter):
        return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")

    def run(x: pa.Array) -> pa.Array:
        return pa.array([count(v or "") for v in x.to_pylist()], pa.int32())

    return arrow_udf(run, "int")(text)


def book_number(filename: Column) -> Column:
    """The leading number of a file's name; an error if there is none."""
    digits = F.regexp_extract(filename, r"^(\d+)", 1)
    return F.when(digits != "", digits.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no book number in "), F.coalesce(filename, F.lit("null")))).cast("int"))


def book_title(filename: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), r"^\d+[_\s-]*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(stem, "[_-]", " "), r"(?i)\s*chunks$", ""))


def relationship_id(source: Column, target: Column, book: Column, chapter: Column) -> Column:
    return F.md5(F.concat_ws("|", source, target, book.cast("string"), chapter))


def entity_id(name: Column, chapter: Column) -> Column:
    return F.md5(F.concat_ws("|", name, chapter))


def entity_key(name: Column, book: Column, chapter: Column) -> Column:
    return F.concat_ws("|", name, book.cast("string"), chapter)


def strip_fence(reply: Column) -> Column:
    """A reply without the code fence around it; one that isn't fenced stays."""
    body = F.regexp_extract(F.trim(reply), r"(?s)^```[^\n]*\n(.*?)\n?```\s*$", 1)
    return F.when(F.trim(reply).rlike(r"(?s)^```[^\n]*\n.*```\s*$"), body).otherwise(F.trim(reply))


def chunk_number(unit_id: Column) -> Column:
    digits = F.regexp_extract(unit_id, r"_chunk_(\d+)", 1)
    return F.when(digits != "", digits.cast("double")).otherwise(F.lit(999.0))


def chapter_of(headings: Column) -> Column:
    return F.coalesce(F.get(headings, 0), F.lit("Unknown"))


def weight(strength: Column) -> Column:
    return F.coalesce(strength, F.lit(5)) / F.lit(10.0)


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def escape_markdown(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def preview(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def source_ids(context: Column) -> Column:
    return F.regexp_extract_all(context, F.lit(r"book\d+_chunk_\d+"), F.lit(0))


def truncated(text: Column, most: int) -> Column:
    """The first ``most`` characters, without a mark."""
    return F.substring(text, 1, most)


def token_pieces(text: Column, most: int) -> Column:
    """The text in pieces of at most ``most`` tokens by the offline count; an empty text is one piece."""
    n, step = F.length(text), most * 4
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / step)).cast("int")), lambda k: F.substring(text, k * step + 1, F.lit(step)))


def book_hints(question: Column) -> Column:
    """Books that a question points to, or null."""
    low, out = F.lower(question), None
    for pattern, books in HINTS:
        found, value = low.rlike(pattern), F.array(*map(F.lit, books))
        out = F.when(found, value) if out is None else out.when(found, value)
    return out


def book_list(argument: str) -> list[int]:
    """A comma-separated list of book numbers; an error names what isn't one."""
    return [int(x) for x in argument.split(",") if x.strip()]


def parse_json(reply: Column, schema: str) -> Column:
    """A model's reply as a struct; null if it is blank."""
    body = strip_fence(reply)
    return F.when(F.length(F.coalesce(body, F.lit(""))) > 0, F.from_json(body, schema))
