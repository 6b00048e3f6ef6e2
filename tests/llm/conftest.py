import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text[, lang, source]) rows, with extra columns whose names clash with inner ones."""

    def build(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("key", "size", "shard", "kept", "h", "v", "salt", "_w", "_t", "_row", "_sha", "_gone", "_d", "_copies", "id", "bands", "tokens", "recipe", "part", "budget"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return build
