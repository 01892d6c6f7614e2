import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from texts, or from (doc_id, text) pairs."""

    def make(items, sources=None):
        pairs = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(items)]
        rows = [(i, t, "en", sources[k] if sources else f"src{k % 3}", len(t) if t is not None else None) for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
