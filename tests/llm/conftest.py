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
LONG = " ".join(f"word{i % 977} of a very long text, number {i};" for i in range(30_000))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text), with the other columns of the table."""
    from cashplan.session import ship

    ship(spark)

    def make(rows):
        full = [(i, text, "en", "src", None if text is None else len(text)) for i, text in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, make_docs):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named as results are."""
    from pyspark.sql import functions as F

    rows = [(1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (4, LONG), (None, "a b c d"), (None, None), (5, " \n\t ")]
    docs = make_docs(rows).withColumn("n_chars", F.lit(None).cast("long")).withColumn("lang", F.lit(None).cast("string"))
    for name in ("score", "fingerprint", "component_id", "fp", "hits", "n_words", "spans", "text_", "slots", "pick", "blob"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
