import pytest
from pyspark.sql import functions as F

CLASHING = ["score", "kept", "fp", "block", "rank", "chunk", "value", "bucket", "key", "name", "start", "slot", "row", "line", "gram", "kind"]
LONG = " ".join(f"word{i % 977}ing" for i in range(60_000)) + "."


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows, and columns of clashing names."""
    rows = [
        (1, "One plain sentence of more than ten words stands here in this text.", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0),
        (None, "A row without an id but with a text of quite some words in it, no more.", "en", "b", 1), (5, LONG, "en", "a", 9), (6, " \t\n ", "de", "b", 3),
        (7, "same same same same same same same same same same same same same same", None, "b", 2),
        (7, "same same same same same same same same same same same same same same", None, "b", 2),
        (8, "ÄÖÜ ß é 漢字   <|endoftext|> a  b\n\nTwo. Lines!\n", "fr", None, 4), (9, "One plain sentence of more than ten words stands here in this text.", "en", "b", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({name: F.lit("x") for name in CLASHING})


@pytest.fixture(scope="session")
def no_docs(messy):
    return messy.where("false")


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 0), (7, 0, 0), (9, 1, None), (None, 1, 1), (8, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
