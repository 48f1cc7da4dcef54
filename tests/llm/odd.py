"""Odd inputs for every operator: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

LONG = "word " * 30_000
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", "en", "a", 6),
    (4, "one two three four five", "en", "a", 23),
    (5, "one two three four five", "en", None, 23),
    (5, "one two three four five", "en", None, 23),
    (6, LONG, "en", "b", len(LONG)),
    (7, "mail a.b@c.example or +1 (555) 123-4567 from 10.0.0.1 and 4111 1111 1111 1111", "en", "b", 78),
    (8, "é日本😀 ▁ \x00 ß", "de", "b", 10),
    (9, "x" * 20_000, "de", "b", 20_000),
    (None, "no id", "de", "b", 5),
]
CLASH = ("score", "label", "fp", "component", "spans", "base", "terms", "copy", "_spans", "_copy", "w", "c", "block", "ids", "shard", "slot", "file", "old", "train", "count")


def docs(spark, rows=ROWS):
    """The odd documents with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def empty(spark):
    return docs(spark, [])
