import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of small tables with the columns of `documents`; texts may be given alone."""
    def make(rows, extra=""):
        full = [r if isinstance(r, tuple) else (i, r, "en", "src", len(r or "")) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long" + extra)
    return make
