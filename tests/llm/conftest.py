import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows to a frame whose columns clash with names that operators use inside."""

    def make(rows, schema="doc_id long, text string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema)
        extra = {c: F.lit("x") for c in ("size", "key", "n", "words", "label", "spans", "range", "window", "seed", "_row", "_clean", "_key", "_spans", "_leak", "_later", "row", "id", "clean", "leak", "later", "kind", "band") if c not in df.columns}
        return df.withColumns(extra)

    return make
