import pytest


@pytest.fixture
def docs(spark):
    """Rows to documents with an extra column whose name clashes with results."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long, score string, taken string"):
        full = [(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows]
        return spark.createDataFrame(full, schema)

    return make
