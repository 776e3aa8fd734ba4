import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source)."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty, blank and long texts, ties, repeated rows, and columns with names that operators use inside."""
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k l"), (None, "a b c d e f g h i j k l"), (None, None, None), (6, "word " * 60_000), (7, "x" * 200_000), (8, "1 " * 5_000, None), (9, "é" * 1000 + "\n\n" + "日本 語"), (5, "another text with the same id")]
    frame = docs_of(rows)
    names = ("id", "key", "row", "found", "cls", "n", "token", "size", "target", "taken", "range", "bad", "drop", "lines", "leaves", "m", "spans", "base", "w", "hits", "score", "digest", "license", "n_dropped", "ID2", "__row_key")
    for name in names:
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


ODD_ROWS = 13
