"""Prompt columns."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F

# Fixed value: put before a question, and only a question, when it is embedded.
QUESTION_PREFIX = "Represent this sentence for searching relevant passages: \n"

# Fixed value: put before every chunk in a context.
PARAGRAPH_PREFIX = "\nParagraph: \n"


def prefixed_question(question: Column, prefix: str = QUESTION_PREFIX) -> Column:
    return F.concat(F.lit(prefix), question)


def render(template: str, **values: Column) -> Column:
    """Fill ``{name}`` places of a template from columns.

    The template is cut up once on the driver, so braces that occur inside a
    context or a question are text and never a place to fill.
    """
    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(F.coalesce(values[name], F.lit("")))
    return F.concat(*pieces)
