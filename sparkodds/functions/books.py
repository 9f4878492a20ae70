"""Order-book JSON: ``[["price","qty"], ...]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkodds.functions.timefn import col

LEVELS = "array<array<string>>"


def levels(book_json: Column | str) -> Column:
    return F.from_json(col(book_json), LEVELS)


def top_of(parsed: Column | str, end: Column | str) -> Column:
    """``struct(price, size)`` of the last or first of the parsed levels as
    doubles; both fields are NULL when the side is empty. ``end`` is 'last',
    'first' or a condition that is true for 'last'."""
    if isinstance(end, str):
        end = F.lit(end == "last")
    level = F.try_element_at(col(parsed), F.when(end, -1).otherwise(1))
    return F.struct(
        F.get(level, F.lit(0)).cast("double").alias("price"),
        F.get(level, F.lit(1)).cast("double").alias("size"),
    )


def top(book_json: Column | str, end: Column | str) -> Column:
    return top_of(levels(book_json), end)


def complement(price: Column | str) -> Column:
    """Ask of the outcome from the best bid on its opposite."""
    return F.lit(1.0) - col(price)
