import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) pairs, or from texts."""

    def make(rows, lang=None):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def words_of():
    """n distinct words by a seed."""
    import random

    def make(n, seed):
        r = random.Random(seed)
        return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n)]

    return make
