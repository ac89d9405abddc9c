import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, dealt over several partitions."""

    def make(rows, parts=3, schema="doc_id long, text string, lang string, source string, n_chars long"):
        full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(parts)

    return make
