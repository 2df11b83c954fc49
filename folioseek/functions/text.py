"""Text columns: tokens, cleaning and sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# What separates tokens, and what ends a sentence.
TOKEN_GAP = "[ \\n\\t\\r]+"
SENTENCE_END = "[.!?\\n]+"

# The characters that count as whitespace at the ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Marks a layout service leaves for check boxes.
SELECTION_MARKS = (":selected:", ":unselected:")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    Catalyst may paste a column's expression into every place that names it,
    also inside a lambda, where it would run once per array element. A lambda
    variable is never pasted.
    """
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Whitespace tokens in order; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), TOKEN_GAP), "")


def terms(text: Column) -> Column:
    """Distinct lower-cased tokens."""
    return F.array_distinct(tokens(F.lower(text)))


def drop_selection_marks(content: Column) -> Column:
    for mark in SELECTION_MARKS:
        content = F.replace(content, F.lit(mark), F.lit(""))
    return content


def clean_layout_text(content: Column) -> Column:
    """Text as it is compared: no marks, no newlines, no outer whitespace."""
    joined = F.replace(drop_selection_marks(content), F.lit("\n"), F.lit(""))
    return F.btrim(joined, F.lit(BLANKS))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences in order."""
    parts = F.split(F.coalesce(text, F.lit("")), SENTENCE_END)
    return F.array_remove(F.transform(parts, lambda part: F.trim(part)), "")
