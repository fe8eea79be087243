import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _fp string, size string, bucket int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    long_ = "alpha beta gamma delta epsilon " * 3000
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10, "x", "y", 1),
        (2, "The quick brown fox JUMPS over the lazy dog again and again", "en", "a", 10, "x", "y", 1),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, None, None, None),
        (5, long_, "en", "b", len(long_), None, None, None),
        (6, "ñandú über straße 日本語 \x0b tab\tnew\nline", "de", "é", 30, None, None, None),
        (7, "x", "de", None, 1, None, None, None),
        (7, "x", "de", None, 1, None, None, None),
        (None, "no id here at all", "en", "b", 3, None, None, None),
        (8, "   \n\t ", "en", "c", 6, None, None, None),
        (9, "12345 67890", "en", "c", 6, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
