"""Small tables that hold the awkward cases every operator must survive."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LONG = " ".join(f"word{i % 997} thing{i % 89}" for i in range(30_000))


def edge_rows():
    body = "The quick brown fox jumps over the lazy dog while eleven more animals look on from the hill. " * 3
    return [
        (1, body, "en", "a", 0),
        (2, body, "en", "a", 0),  # a copy
        (3, body + "Once more with feeling.", "en", "a", 0),  # a near copy
        (4, None, "en", "a", None),
        (5, "", None, None, 0),
        (6, " \t\n\x0b\f\r ", "fr", None, 6),
        (7, "word", "fr", "b", 4),
        (8, "one two three four", "de", "b", 18),
        (9, LONG, "en", "b", len(LONG)),
        (10, "é ü 漢字 😀   nb​sp \x1c", None, "c", 1),
        (10, "é ü 漢字 😀   nb​sp \x1c", None, "c", 1),  # a repeated row
        (None, "a text without an id but with plenty of words in it to pass every base rule there is", "en", "c", 3),
        (12, "x" * 5000, "en", "c", 5000),
        (13, "same line\n" * 50, "en", "c", 500),
        (14, "###$$$%%% &&& <<<>>> ||| *** " * 20, "en", "c", 1),
    ]


def edge_docs(spark, rows=None):
    """The rows, with columns whose names clash with what operators make."""
    df = spark.createDataFrame(edge_rows() if rows is None else rows, SCHEMA)
    return df.selectExpr("*", "'x' as kept", "1 as size", "2 as copies", "3 as host", "'y' as ids", "4 as n_lines")
