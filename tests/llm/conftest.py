"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, run int, score double, keep_id long"


@pytest.fixture(scope="session")
def odd_rows():
    long = " ".join(f"word{i * i % 977}" for i in range(30_000))
    texts = {
        1: "The quick  brown fox\tjumps", 2: "The quick brown fox jumps", 3: None, 4: "", 5: "The quick brown\nfox jumps",
        6: " ", 7: "été password = \"abcdefghijkl\" fin", 8: long, 9: long + " x", 10: "a\x00b \U0001f642 token: 0123456789abcdef0123",
    }
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, len(t or ""), i, 0.5, i) for i, t in texts.items()]
    return [*rows, rows[0], (None, "The quick brown fox jumps", "en", None, None, None, None, None), (None, None, *[None] * 6)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
