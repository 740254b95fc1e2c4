"""A table with everything that may be wrong with one."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, blob string, fp long, length int, side int, key string, n int, kept boolean, component_id long"
LONG = "lorem ipsum dolor sit amet consectetur " * 60_000

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. token = abcdef1234567890", "en", "a", 10),
    (1, "The quick brown fox jumps over the lazy dog. token = abcdef1234567890", "en", "a", 10),  # repeated row
    (2, None, "en", "b", None),
    (3, "", None, "a", 0),
    (None, "Ein Text ohne Nummer, mit Wörtern und Zeichen", "de", None, 5),
    (5, "   \t\n ", "fr", "c", 6),
    (6, LONG, "la", "a", len(LONG)),
    (7, "é", None, None, 1),
    (8, "The quick brown fox jumps over the lazy dog. token = abcdef1234567890", "en", "c", 10),  # copy
    (1, "another text under a known number", "en", "b", 3),
    (9, "12345 67890 !!! ???", "en", "a", 3),
]


@pytest.fixture(scope="session")
def nasty(spark):
    rows = [(*r, 1, "x", 2, 3, 4, "k", 5, True, 6) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
