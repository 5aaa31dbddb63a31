import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Rows -> a documents frame with clashing extra columns; rows are (doc_id, text) or (doc_id, text, lang)."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, 1, "x", 2, None) for r in rows]
        return spark.createDataFrame(full, DOCS + ", id long, fp string, score long, label string")

    return make


ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three"), (6, "The quick brown fox jumps over the lazy dog"), (7, "The quick brown fox jumps over the lazy dog"),
    (7, "The quick brown fox jumps over the lazy dog"), (None, "no id here at all"), (None, None), (8, "é ü ñ ß \U0001f600 日本語"), (9, "word " * 30000), (10, "x" * 200000), (11, "a\x00b"),
]
