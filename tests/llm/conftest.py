import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from texts: ids from 0, or (id, text)."""

    def make(texts, more=None):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(rows, DOCS)
        return df.withColumns(more) if more else df

    return make
