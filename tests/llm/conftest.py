import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of documents from (doc_id, text[, lang[, source]])."""

    def build(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def rows_of():
    """A frame's rows as sorted tuples of the named columns."""
    return lambda df, *columns: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
