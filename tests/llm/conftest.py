import sys
from pathlib import Path

import pytest
from pyspark.sql import Row

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


@pytest.fixture(scope="session")
def documents(spark):
    return table(spark, "documents")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty, blank and long texts, repeated rows, ties and copies."""
    long_text = " ".join(f"word{i % 977} of{i % 31}" for i in range(40_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "One two", "en", "b", 7), (5, "one  TWO", "de", "b", 8),
        (6, "!!! ??? ...", "en", None, 11), (7, long_text, "en", "a", len(long_text)), (8, long_text + " end", "en", "a", None), (None, "a row without id and some words", "en", "a", 1),
        (9, "same row", "fr", "c", 8), (9, "same row", "fr", "c", 8), (10, "é" * 300 + " ñandú 漢字 \x1f x", "es", "c", 1), (-5, "negative id " * 30, "en", "\U0001f600", 1), (11, "ab" * 500, None, "￮", 1),
    ]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def clashing(spark):
    """Documents whose other columns have names that operators use themselves."""
    names = ["_found", "_row", "_fp", "fingerprint", "size", "copies", "_key", "n_words", "score", "c0", "part", "weight", "_size", "key", "node", "root", "_keep", "_p", "hi", "v"]
    return spark.createDataFrame([Row(doc_id=i, text=f"text number {i} with words", lang="en", source="s", **dict.fromkeys(names, i)) for i in range(6)])
