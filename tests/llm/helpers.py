"""Small tables with the awkward cases in them."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, filter_word string, id bigint"
WORDS = "the quick brown fox jumps over lazy dogs while seven wizards boil strange potions beneath a pale moon and count every falling star".split()


def prose(seed: int, words: int = 40) -> str:
    return " ".join(WORDS[(seed * 7 + i * (seed % 5 + 1) + i * i) % len(WORDS)] + ("." if i % 9 == 8 else "") for i in range(words))


def rows() -> list[tuple]:
    """Null and empty texts, white space only, one word, long and repeated texts, null ids, repeated rows."""
    texts = [None, "", " \t\n", "word", "ﬁne　text\x00 ▁mark  two\n\n three", prose(1), prose(1), prose(1) + " end", prose(2, 3000), "x" * 30_000, "emoji 🙂 é\r\n tail "]
    out = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, 0, "w", i) for i, t in enumerate(texts)]
    return [*out, out[5], (None, prose(3), "de", "s1", 0, "w", 1), (None, None, None, None, None, None, None)]


def documents(spark):
    return spark.createDataFrame(rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
