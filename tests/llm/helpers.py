"""Small document tables with the cases that every operator must take."""

ODD = [
    (1, "Plain words of a short text", "en", "a", 27),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, "Plain words of a short text", "en", "a", 27),
    (4, "Plain words of a short text", "en", "a", 27),
    (5, " \t\n\x0b\x0c\r ", "de", "b", 7),
    (6, "é ñ ü " * 9000, "fr", None, 54000),
    (None, "A text without an id", "en", "a", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def docs(spark, texts, first=0):
    """Documents with ids from ``first`` on."""
    return spark.createDataFrame([(first + k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """``df`` with more columns, named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("fp", "spans", "base", "score", "kept", "starts", "ends", "items", "n_words", "row", "id", "of", "gone", "left", "q", "labels")
    return df.select("*", *[F.lit(f"mine {n}").alias(n) for n in names])
