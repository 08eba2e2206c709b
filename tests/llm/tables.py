"""Small tables with the cases every operator must bear."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgéß") for _ in range(draw.randint(1, 9))) for _ in range(n))


def cases():
    """Nulls in every column, empty, blank, short and long texts, ties, and rows that repeat."""
    long = words(1, 20_000)
    return [
        (1, words(2, 60), "en", "b", 10), (2, words(2, 60), "en", "b", 10), (3, "  " + words(2, 60) + "\n", "en", "a", 12),
        (4, None, "en", "a", None), (5, "", None, None, 0), (6, " \t\n", "de", "a", 3), (7, "one two", "de", "c", 7),
        (7, "one two", "de", "c", 7), (8, "ONE TWO", "de", "c", 7), (9, long, "fr", None, 5), (10, long + " end", "fr", "d", 5),
        (None, words(3, 30), "en", "a", 1), (None, None, None, None, None), (11, "x" * 60_000, "en", "a", 1),
        (12, "line\n" + words(4, 40) + "\nlast", "en", "a", 1), (13, "other\n" + words(4, 40).upper().replace("É", "é").replace("SS", "ß"), "en", "b", 1),
        (14, "it's 1st　a\x85b ퟿ é \U0001f600!?", "en", "b", 1),
    ]


#: Columns that operators might use themselves.
CLASH = ["ids", "kept", "size", "class", "start", "n", "root", "key", "digest", "vector", "host", "rank", "_salt", "_hot", "mark"]


def docs(spark, rows=None, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(cases() if rows is None else rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASH}) if clash else df
