import pytest


@pytest.fixture()
def docs(spark):
    """A documents table from (doc_id, text) rows, with columns that no operator asked for."""

    def make(rows, lang="en", source="s"):
        full = [(r[0], r[1], r[2] if len(r) > 2 else lang, r[3] if len(r) > 3 else source, 0, "x", 1) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key string, h long")

    return make
