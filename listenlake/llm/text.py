"""Column helpers for whole texts: let-bindings, words and scratch for small sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of these characters separate words.
GAP = r"[\x20\x09-\x0D]+"
#: Sides of at most so many rows are broadcast; larger ones are joined by shuffle.
SMALL_ROWS = 1_000_000


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """`df` marked for broadcast if a count shows at most `rows` rows; otherwise as it is.

    `df` should be a stored table of a few narrow columns: it is counted and then read again.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
