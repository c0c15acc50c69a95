import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h string, spans string, ids string"
LONG = "the long text of words goes on and on with password=abcdefghijkl12 at times. " * 3000


def rows(*texts):
    return [(i, t, "en", "s", len(t or ""), "k", "h", "sp", "id") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    made = rows("", "   \n\t ", None, "one", "one two", "the cat sat on the mat", "the cat sat on the mat", LONG, "▁ x \U0001f600 é")
    made += [made[5], (None, None, None, None, None, None, None, None, None), (None, "the cat", None, None, None, None, None, None, None)]
    return spark.createDataFrame(made, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    import os

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("driver test data not present")
    return path
