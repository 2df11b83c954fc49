"""Screen for answers that say nothing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Phrases that mark a non-answer, tested as plain substrings.
NON_ANSWER_PHRASES = (
    "no information",
    "no context",
    "don't know",
    "no clear answer",
    "sorry",
    "not mentioned",
    "do not know",
    "i don't see any information",
    "i cannot provide information",
    "no answer",
    "no mention",
    "not mention",
    "context does not provide",
    "no helpful answer",
    "not specified",
    "not know the answer",
    "no helpful",
    "no relevant",
    "no question",
    "not clear",
    "provide me with the actual context document",
    "i'm ready to assist",
    " does not have the relevant information",
    "does not seem to be directly related",
    "cannot determine",
)

# Fixed value: one more phrase, used by the exploratory variant of the screen.
EXPLORATORY_PHRASE = "not explicitly"


def is_good_answer(answer: Column, phrases: Sequence[str] = NON_ANSWER_PHRASES) -> Column:
    """False for null, empty, a listed phrase anywhere, or a final ``?``."""
    lowered = F.lower(answer)
    says_nothing = reduce(
        lambda left, right: left | right, [F.contains(lowered, F.lit(p)) for p in phrases], F.lit(False)
    )
    good = (answer != "") & ~F.endswith(answer, F.lit("?")) & ~says_nothing
    return F.coalesce(good, F.lit(False))
