import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]), with columns of clashing names if asked for."""

    def make(rows, clash=()):
        data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1]) if r[1] else None) for r in rows]
        df = spark.createDataFrame(data, DOCS)
        for name in clash:
            df = df.withColumn(name, df["doc_id"] * 2)
        return df

    return make
