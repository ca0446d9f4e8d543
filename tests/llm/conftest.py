import pytest


@pytest.fixture(scope="session")
def make(spark):
    def build(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def odd_docs(make):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, and columns with the names that operators use."""
    long = "word " * 30_000 + "end"
    rows = [(1, None, None, "x"), (2, "", "en", None), (3, " \n\t ", "de", "x"), (4, "Same text here, again and again.", "en", "x"), (4, "Same text here, again and again.", "en", "x"), (5, "Same text here, again and again.", None, "x"), (None, "no id", "en", "x"), (None, "no id", "en", "x"), (6, long, "fr", "x"), (7, "éß \U0001f600 你好", "fr", "x")]
    return make([(*r, 1, True, 2.0) for r in rows], "doc_id long, text string, lang string, source string, score int, kept boolean, length double")


@pytest.fixture(scope="session")
def no_docs(make):
    return make([], "doc_id long, text string, lang string, source string, score int, kept boolean, length double")
