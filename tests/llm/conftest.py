import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use inside.
    T.StructField("body", T.StringType()), T.StructField("node", T.LongType()), T.StructField("component", T.StringType())])


@pytest.fixture
def documents(spark):
    """Build a documents table from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def build(*rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "src0")), len(r[1]) if r[1] is not None else None, "x", 1, "y") for r in rows]
        return spark.createDataFrame(full, DOCUMENT)

    return build
