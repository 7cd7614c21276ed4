"""Column builders shared by the operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.columns import once

__all__ = ["SPACE", "WORD_CHAR", "let", "matches", "once", "words_of"]

#: Characters that separate words: the space and the six controls from tab on.
SPACE = r"[\x20\x09-\x0D]"
WORD_CHAR = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once.

    A lambda variable holds a computed array, so a later lambda that reads it for each of its own
    elements doesn't compute it again, whatever the optimizer does with the projections around it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than SPACE, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def matches(text: Column, regex: str) -> Column:
    """How often regex matches: the parts that it cuts the text into, less one. On long texts this takes
    a small part of the time of regexp_count."""
    return F.size(F.split(text, regex, -1)) - 1
