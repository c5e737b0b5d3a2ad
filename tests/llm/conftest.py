import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
    # Names that the operators use themselves.
    T.StructField("_row", T.StringType()), T.StructField("mark", T.LongType()), T.StructField("copies", T.IntegerType()),
    T.StructField("n_words", T.StringType()), T.StructField("_text", T.StringType()), T.StructField("kept", T.StringType()),
])


@pytest.fixture(scope="session")
def docs_of(spark):
    def made(rows):
        return spark.createDataFrame([(i, t, s, "x", 1, 2, "y", "z", "k") for i, t, s in rows], DOCS)

    return made


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, and text that ends in a half-made word."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()
    passage = " ".join(words)
    long = " ".join(f"{w}{i}" for i in range(4000) for w in words)
    return [
        (1, passage, "a"), (1, passage, "a"), (2, passage, "b"), (3, None, "a"), (4, "", None), (5, " \t\n ", "b"),
        (None, passage + " rho sigma", None), (None, None, None), (6, long, "a"), (7, "Ünï " + passage.upper() + "\n" + passage, "b"),
        (8, "same same same " * 60, "c"), (9, long[:50_000] + " end", "a"), (9, "another text under an id that repeats", "a"),
    ]
