"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that separates words, one expression for Spark and one for Python.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Most rows of one number, or a few, that an operator broadcasts; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def one_spaced(text: Column) -> Column:
    """Every run of white space as one blank."""
    return F.regexp_replace(text, SPACE_RUN, " ")


def if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a stored table, with a broadcast hint if its counted rows allow it; the join is right either way."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
