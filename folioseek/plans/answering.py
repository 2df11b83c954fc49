"""Questions to answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from folioseek.config import CHUNKS_PER_CONTEXT, DEFAULT_K, DEFAULT_MODEL, TEMPLATES, model_settings
from folioseek.operators.answers import (
    Reply,
    answer_extractive,
    answer_in_rounds,
    first_good_answers,
    generate_answers,
    render_prompts,
)
from folioseek.operators.contexts import context_groups
from folioseek.operators.index import ChunkIndex


def answer_questions(
    questions: DataFrame, index: ChunkIndex, k: int = DEFAULT_K, per_group: int = CHUNKS_PER_CONTEXT
) -> DataFrame:
    """One record per ``(question_id, question)`` with the built-in extractive answerer."""
    contexts = context_groups(index.retrieve_texts(questions, k), per_group)
    return first_good_answers(answer_extractive(contexts, questions), questions)


def answer_questions_with_model(
    questions: DataFrame,
    index: ChunkIndex,
    model: Callable[[str], Reply] | None = None,
    model_id: str = DEFAULT_MODEL,
    k: int = DEFAULT_K,
    per_group: int = CHUNKS_PER_CONTEXT,
    template: str | None = None,
    **retry,
) -> DataFrame:
    """Like ``answer_questions`` with a user's model, asked no more often than needed, and ``error``.

    ``template`` is a text or the name of one of ``TEMPLATES``.
    """
    contexts = context_groups(index.retrieve_texts(questions, k), per_group)
    text = TEMPLATES.get(template, template) if template else model_settings(model_id).template
    prompts = render_prompts(contexts, questions, text)
    num_groups = -(-k // per_group)
    return answer_in_rounds(
        prompts, questions, lambda turn: generate_answers(turn, model, **retry), num_groups
    )
