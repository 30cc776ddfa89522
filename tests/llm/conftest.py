import pytest

#: Nulls, empty and white texts, repeats, odd white space, long texts and ties.
TEXTS = [
    None, "", "   \t\n", "one", "One  two three\x0bFOUR", "a" * 5000, " ".join(f"w{i % 97}" for i in range(30_000)), "Ünï cödé ÉÀ 日本語 текст 🙂 x'll don't 123 4567", "  lead and trail  \n\n x ", "\r\n\r\ntab\t\ttab 　 wide",
    "tail\n", "same words here again and again", "same words here again and again", "<|endoftext|> is text",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with odd texts and ids, repeated rows, and columns whose names clash with inner ones."""
    rows = [(i, t, "en" if i % 3 else None, "src0" if i % 2 else None, len(t or ""), i) for i, t in enumerate(TEXTS)]
    rows += [rows[-2], (None, "no id at all", "en", "src1", 12, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, body int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
