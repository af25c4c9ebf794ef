import pytest


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


EDGE = "doc_id long, text string, lang string, source string, n_chars long, row string, n string, w string, fp string, key string, start string, spans string, v string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, blanks, a long text, repeated rows, equal texts, and columns of clashing names."""
    passage = " ".join(f"word{i} thing" for i in range(60))
    long = " ".join(f"tok{i % 977}x{i}" for i in range(60_000))
    rest = ("a", "b", "c", "d", "e", "f", "g", "h")
    rows = [
        (1, passage, "en", "s1", 5, *rest),
        (2, passage, "en", "s1", 5, *rest),
        (2, passage, "en", "s1", 5, *rest),
        (3, None, None, None, None, *(None,) * 8),
        (4, "", "", "", 0, *rest),
        (5, " \t\n ", "en", "s2", 3, *rest),
        (6, long, "de", None, 9, *rest),
        (None, "a text without an id that has more than ten words in it, as it must", None, "s1", 1, *rest),
        (7, "one", "en", "s2", 3, *rest),
        (8, "Ünïcode 日本語 \x00 ¡öÄ! <|endoftext|> \\ |", "ja", "s2", 3, *rest),
    ]
    return spark.createDataFrame(rows, EDGE)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE)
