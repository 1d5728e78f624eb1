import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("key", T.StringType()), ("size", T.LongType()), ("place", T.StringType()), ("score", T.StringType()), ("group", T.StringType()))])

LONG = "lorem ipsum dolor sit amet " * 9_000 + "x" * 70_000


def doc(k, text, lang="en", source="s", **extra):
    return (k, text, lang, source, None if text is None else len(text), "k", 7, "p", "z", "g")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal texts, and columns whose names operators use."""
    rows = [
        doc(1, "one two three four five six seven"), doc(1, "one two three four five six seven"), doc(2, "one two three four five six seven"),
        doc(3, None), doc(4, ""), doc(None, "a null id has this text"), doc(5, "   \n\t \n"), doc(6, LONG), doc(7, "é 漢字 😀   x\ny\n", None, None), doc(8, "word"), (9,) + (None,) * 9,
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
