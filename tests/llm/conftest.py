import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and blank and very long texts, repeated rows, and columns that clash with names used inside."""
    words = "the quick brown fox jumps over the lazy dog and runs away from it all day long until night falls".split()
    base = " ".join(words)
    rows = [
        (1, base, "en", "a", 10),
        (2, base, "en", "a", 10),
        (3, base + " again", "en", "b", 10),
        (3, base + " again", "en", "b", 10),
        (4, None, None, None, None),
        (5, "", "de", None, 0),
        (6, " \t\n ", "de", "b", 4),
        (7, LONG, None, "a", None),
        (8, "12345 67890", "fr", "c", 11),
        (9, "a", "fr", "\U00010000", 1),
        (10, "naïve ▁ \U0001f600 日本語 \x02 text", "de", "￿", 5),
        (None, "no id here at all but words", "en", "a", 3),
        (11, "x" * 100_000, "en", "a", 3),
    ]
    extra = "rep long, score double, kind string, spans string, words long, key string, size long, rank int, _text string"
    return spark.createDataFrame([(*r, 1, 0.5, "k", "s", 2, "q", 3, 4, "t") for r in rows], f"{DOCUMENTS}, {extra}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
