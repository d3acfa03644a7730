import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from texts, or from (doc_id, text, lang, source) rows, dealt over several partitions."""

    def make(rows, partitions=3):
        rows = [(i, r, "en", "s") if r is None or isinstance(r, str) else r for i, r in enumerate(rows)]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCUMENT).repartition(partitions)

    return make
