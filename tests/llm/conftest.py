import pytest


@pytest.fixture
def documents(spark):
    """documents(rows): a table of (doc_id, text) plus columns whose names clash with results."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src0", "x", -1) for i, t in rows],
                                     "doc_id long, text string, lang string, source string, "
                                     "fingerprint string, score int")
    return make


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest documents table: rows as (doc_id, text)."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return [(r["doc_id"], r["text"]) for r in table.collect()]
