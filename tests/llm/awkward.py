"""Small tables with everything that operators have to bear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, `set` int, row string, `odd name` int"

LONG = "lorem ipsum dolor sit amet " * 20_000

ROWS = [
    (1, "a plain text of some words that say little", "en", "s1", 10, "x", 1, "r", 1),
    (2, "a plain text of some words that say little", "en", "s1", 10, "x", 1, "r", 1),
    (2, "a plain text of some words that say little", "en", "s1", 10, "x", 1, "r", 1),
    (3, None, "en", "s2", None, None, None, None, None),
    (4, "", None, None, 0, None, None, None, None),
    (5, " \t\n \r\n", "de", "s2", 5, "y", 2, "r", 2),
    (6, LONG, "la", "s3", len(LONG), "z", 3, "r", 3),
    (7, "x" * 5_000, "en", "s3", 5_000, "z", 3, "r", 3),
    (8, "12345 !!! ▁   漢字 \U0001f600", None, "s1", 9, None, None, None, None),
    (None, "no id but some words of text", "en", None, 28, None, None, None, None),
    (None, None, None, None, None, None, None, None, None),
    (2**62 + 1, "an id that no float can hold, and some words", "en", "s1", 2**60 + 1, "x", 1, "r", 1),
    (9, "Größe und Straße\nund noch mehr\n\nund noch mehr", "de", "s2", 40, "w", 4, "r", 4),
    (-5, "a plain text of some words that say nothing", "en", "s1", 10, "x", 1, "r", 1),
]


def docs(spark: SparkSession, rows: list | None = None) -> DataFrame:
    return spark.createDataFrame(ROWS if rows is None else rows, DOCS)
