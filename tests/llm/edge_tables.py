"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names, shared by the tests."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("lang", T.StringType()),
        # Names that operators use for columns of their own.
        T.StructField("n_words", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("words", T.StringType()),
        T.StructField("place", T.StringType()),
    ]
)
LONG = " ".join(f"word{i % 977} and\tmore{i % 31}" for i in range(20_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, "  two  blanks \n\n and odd \x0b spaces\t", "b"),
    (5, LONG, "a"),
    (5, LONG, "a"),
    (None, "no id here", "c"),
    (7, "x", "c"),
    (8, "Ä ß 漢字 🙂 <|endoftext|> it's we'll <s>", None),
    (9, "same line\nsame line\nsame line", "a"),
    (10, "The quick brown fox jumps over the lazy dog again and again.", "b"),
    (11, " \n\t ", "b"),
]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, s, "en", "c1", "c2", "c3", "c4", "c5", "c6") for i, t, s in texts], DOCS)


def empty(spark):
    return docs(spark, [])
