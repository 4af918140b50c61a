import pytest

from furrow.session import configure

# one of each hard case: null and empty texts, blanks only, ties, repeated rows, a very long text
LONG = " ".join(f"word{i % 700}" for i in range(30_000))
ROWS = [
    (1, "The cat and the dog of the house is in it. " * 12, "en", "a", 5),
    (1, "The cat and the dog of the house is in it. " * 12, "en", "a", 5),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n\x0b\x0c\r ", "fr", "b", 7),
    (None, "one two three four five six seven", "xx", None, 1),
    (6, LONG, "en", "b", 9),
    (7, "#|# 55 $$ %% && ** <x> " * 40, "de", "c", 3),
    (8, "Línea una\nLínea una\n\n \nLínea dos é ü", "es", "c", 2),
    (9, "a b", "en", "", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard(spark):
    """Hard rows, with further columns whose names clash with those the operators use."""
    from pyspark.sql import functions as F

    rows = configure(spark).createDataFrame(ROWS, SCHEMA)
    return rows.withColumns({c: F.lit(f"own {c}") for c in ("size", "copies", "kept", "rank", "target", "words", "h", "id", "n", "shard")})


@pytest.fixture(scope="session")
def none(hard):
    return hard.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return configure(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")
