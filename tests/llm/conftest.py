import pytest


@pytest.fixture
def docs(spark):
    """Build a table of documents from (doc_id, text) pairs, with a column whose name clashes."""

    def make(rows, extra="score string"):
        name = extra.split()[0]
        schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
        full = [(i, t, "en", "s", len(t or ""), name) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return make
