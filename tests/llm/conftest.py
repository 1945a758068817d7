import pytest
from pyspark.sql import types as T

#: A documents table with a column that operators use as a name of their own.
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("h", T.StringType()), T.StructField("ids", T.StringType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text[, lang]) rows, in several partitions."""

    def make(rows, partitions=3):
        data = [(r[0], r[1], r[2] if len(r) > 2 else "en", "x", "y", "z") for r in rows]
        return spark.createDataFrame(data, DOCS).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Nulls, empty and blank texts, a very long one, ties and repeated rows."""
    long = "word " * 30_000 + "end"
    return make_docs([
        (1, None), (2, ""), (3, " \t\n"), (4, "A b c"), (4, "A b c"), (5, "A  b c"), (6, "Abc"), (None, "a null id"), (None, "a null id"),
        (7, long), (8, long + " more"), (9, "É\x1c😀 ß"), (4, "another text"), (10, "x"),
    ])
