import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a table like documents from texts, or (id, text) or (id, text, lang) rows, with columns whose names clash with inner ones."""

    def make(rows):
        full = []
        for k, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (k, r)
            full.append((r[0], r[1], r[2] if len(r) > 2 else "en", "s", 1))
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "1 AS n", "2 AS ids", "'x' AS words", "3 AS bin", "4 AS fill", "5 AS label", "6 AS url", "'c' AS class", "7 AS rep", "true AS train", "8 AS score")

    return make


@pytest.fixture
def hard_texts():
    """Null, empty, blank, very long, one very long word, repeated, special tokens, odd characters."""
    return [None, "", " \n\t ", "word " * 30_000, "x" * 50_000, "same text here", "same text here", "a<|endoftext|>b", "naïve 😀 \u2028 \x00 中文 ‮", "\x1c a\u00a0b"]
