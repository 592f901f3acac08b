import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows_of(texts, first=0):
    return [(first + i, t, "en", None if i % 5 == 4 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


ODD = [None, "", " ", "one", "one", "The cat sat. " * 3000, "é日😀" * 50, "a" * 5000, "x\n\n y \t z", "DER Der der Der Der Der Der Der Der Der Der Der", "The cat sat on the mat and was glad of it all day long today."]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents: nulls, empty, long, repeated, one row without an id, extra columns with names that operators use."""
    rows = [(*r, "x", 1.0, [1]) for r in [*rows_of(ODD), *rows_of(ODD)[3:5], (None, "no id here", None, None, None)]]
    return spark.createDataFrame(rows, DOCS + ", keep string, score double, ids array<int>")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
