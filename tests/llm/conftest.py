import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, spans string, score double, text_key string, position double"


@pytest.fixture
def documents(spark):
    """Makes documents from (doc_id, text[, lang[, source]]), with further columns whose names the operators use inside."""

    def make(rows):
        full = [(r[0], r[1], *(list(r[2:]) + [None, None])[:2], None, 1, 2, "x", 0.5, "k", 0.1) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
