import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents table from (doc_id, text) pairs, with the usual columns and one that clashes."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        data = [(d, t, "en", "s", len(t or "")) for d, t in rows]
        if not extra:
            return spark.createDataFrame(data, schema)
        names = ", id long, n long, bands string, component string, length long, rank long, label int"
        return spark.createDataFrame([(*r, 1, 2, "b", "c", 3, 4, 5) for r in data], schema + names)

    return make
