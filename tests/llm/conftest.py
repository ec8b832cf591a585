import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents-like frame from (doc_id, text) pairs, with extra columns whose names clash with inner ones."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "x", "y", 1, 2, 3) for i, t in rows],
            "doc_id long, text string, key string, ids string, length int, u int, component int").repartition(3)

    return make
