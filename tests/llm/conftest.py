import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Small tables from rows, with the columns of ``documents`` unless said otherwise."""

    def make(rows, ddl="doc_id long, text string, lang string, source string, n_chars long", parts=3):
        width = len(ddl.split(","))
        full = [tuple(r) + (None,) * (width - len(r)) for r in rows]
        return spark.createDataFrame(full, ddl).repartition(parts)

    return make
