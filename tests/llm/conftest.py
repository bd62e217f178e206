import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Make a documents table from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture()
def odd(docs):
    """Nulls in every column, empty and blank texts, a long one, ties and repeated rows."""
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "a b c d e f g h"), (2, None), (None, None), (3, ""), (4, "  \n\n "), (5, "word"), (6, "x" * 5000 + " " + "y z " * 4000), (7, "é ü 你好 🙂\nline two\nline two")]
    extra = [(*r, None if i % 3 == 0 else f"s{i % 2}") for i, r in enumerate(rows)]
    return docs(extra)
