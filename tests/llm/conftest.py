import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) rows, with a clashing extra column."""
    def make(rows, extra=None):
        data = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows]
        return spark.createDataFrame(
            data, "doc_id long, text string, lang string, source string, n_chars long, fp string")
    return make
