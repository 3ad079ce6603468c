import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that an input may have besides, with names that operators use.
CLASHING = ["row", "content", "text_class", "n", "pos", "tokens", "leaf", "kind", "value", "level", "part", "_id", "_content", "_gone", "_new", "length", "bucket"]


@pytest.fixture(scope="session")
def documents(spark):
    """A table of (doc_id, text) rows, and others if given."""

    def make(rows):
        full = [(*r, *("en", "web", None)[len(r) - 2 :]) if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def clashing():
    from pyspark.sql import functions as F

    return lambda df: df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])
