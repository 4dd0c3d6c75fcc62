import pytest


@pytest.fixture()
def documents(spark):
    """A documents table of (doc_id, text) rows with clashing extra columns."""
    def make(texts, ids=None):
        rows = [(i, t, "id", 1.0, None, "src") for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, id string, n double, sid long, source string")
    return make
