"""Tables that the tests of the training-data operators share."""

from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"

#: texts that every operator must take
ODD = [None, "", " \n\t", "x", "word", "one two three four five", "é" * 300, "9" * 40, "a" * 50_000,
       "the quick brown fox jumps over the lazy dog " * 4000, "\U0001F600 emoji \U0001F600", "tab\tand\x0bmore\x1cseps　wide"]


def documents(spark, rows):
    """A table with the columns of ``documents`` from ``(doc_id, text)`` rows."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s0"), "n_chars": F.char_length("text").cast("long")})
