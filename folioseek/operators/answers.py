"""Answers to contexts, and the first good one per question."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folioseek.config import ModelSettings
from folioseek.functions.prompts import PARAGRAPH_PREFIX, render
from folioseek.functions.screening import NON_ANSWER_PHRASES, is_good_answer
from folioseek.functions.text import let, sentences, terms
from folioseek.sources.scratch import written
from folioseek.sources.workers import loaded

# The record of a question that no context answers.
NO_ANSWER = "Could not fine answer please rephrase the question or provide more context?"
NOT_AVAILABLE = "NA"

# Fixed value: the sentence of a model that has no answer.
DO_NOT_KNOW = "I don't know"

ANSWER_FIELDS = ("answer", "source", "output_metadata", "vector_doc")


def extractive_answer(context: Column, question: Column) -> Column:
    """``struct(score, answer)``: the sentence that shares most terms with the question.

    Equal scores go to the first sentence; a score of 0 says it does not know.
    """
    marker = PARAGRAPH_PREFIX.strip()

    def best(asked: Column) -> Column:
        scored = F.transform(
            F.filter(sentences(context), lambda sentence: sentence != marker),
            lambda sentence, at: F.struct(
                (-F.size(F.array_intersect(terms(sentence), asked))).alias("below"),
                at.alias("at"),
                sentence.alias("sentence"),
            ),
        )
        return let(
            F.array_min(scored),
            lambda top: F.struct(
                F.coalesce(-top["below"], F.lit(0)).alias("score"),
                F.when(top["below"] < 0, top["sentence"]).otherwise(DO_NOT_KNOW).alias("answer"),
            ),
        )

    return let(terms(question), best)


def answer_extractive(contexts: DataFrame, questions: DataFrame) -> DataFrame:
    """Candidate answers ``(question_id, group_no, answer, source, output_metadata, vector_doc)``."""
    asked = contexts.join(questions.select("question_id", "question"), "question_id")
    best = extractive_answer(F.col("context"), F.col("question"))
    return asked.withColumn("best", best).select(
        "question_id",
        "group_no",
        F.col("best.answer").alias("answer"),
        "source",
        F.concat(F.lit('{"shared_terms":'), F.col("best.score").cast("string"), F.lit("}")).alias(
            "output_metadata"
        ),
        F.col("context").alias("vector_doc"),
    )


def render_prompts(contexts: DataFrame, questions: DataFrame, template: str) -> DataFrame:
    """Contexts with the ``prompt`` a model is given."""
    asked = contexts.join(questions.select("question_id", "question"), "question_id")
    return asked.withColumn("prompt", render(template, context=F.col("context"), question=F.col("question")))


def render_prompts_by_model(
    contexts: DataFrame, questions: DataFrame, models: Sequence[ModelSettings]
) -> DataFrame:
    """One prompt per context and model.

    The templates are expressions of one projection, so no row is joined.
    """
    asked = contexts.join(questions.select("question_id", "question"), "question_id")
    prompts = [
        F.struct(
            F.lit(model.model_id).alias("model_id"),
            render(model.template, context=F.col("context"), question=F.col("question")).alias("prompt"),
        )
        for model in models
    ]
    return asked.select("question_id", "group_no", F.inline(F.array(*prompts)))


# A model gives an answer, or an answer and a dict that describes it.
Reply = str | tuple[str, dict] | None


def _called(model: Callable[[str], Reply], prompt: str, seconds: float) -> Reply:
    """What the model replies, or ``TimeoutError``; a daemon thread keeps a call that hangs from holding its task."""
    outcome: list = []

    def call() -> None:
        try:
            outcome.append((model(prompt), None))
        except BaseException as error:  # handed to the caller, whatever it is
            outcome.append((None, error))

    thread = threading.Thread(target=call, daemon=True)
    thread.start()
    thread.join(max(0.0, seconds))
    if not outcome:
        raise TimeoutError
    reply, error = outcome[0]
    if error is not None:
        raise error
    return reply


def ask_with_retry(
    model: Callable[[str], Reply],
    prompt: str,
    busy: type[BaseException] | tuple[type[BaseException], ...],
    timeout_sec: float = 60,
    pause_sec: float = 2,
) -> tuple[str | None, str | None, str | None]:
    """``(answer, metadata, error)``: wait while the model is busy, until the deadline.

    A call that does not return is left behind at the deadline. Any other
    exception is the caller's.
    """
    deadline = time.monotonic() + timeout_sec
    while time.monotonic() < deadline:
        try:
            reply = _called(model, prompt, deadline - time.monotonic())
        except TimeoutError:
            break
        except busy:
            time.sleep(min(pause_sec, max(0.0, deadline - time.monotonic())))
            continue
        answer, metadata = reply if isinstance(reply, tuple) else (reply, None)
        return answer, None if metadata is None else json.dumps(metadata), None
    return None, None, f"no answer within {timeout_sec} seconds"


class ModelBusy(Exception):
    """Raised by a user's model when it wants to be asked again later."""


def generate_answers(
    prompts: DataFrame,
    model: Callable[[str], Reply] | None = None,
    busy: type[BaseException] | tuple[type[BaseException], ...] = ModelBusy,
    timeout_sec: float = 60,
    pause_sec: float = 2,
    load: Callable[[], Callable[[str], Reply]] | None = None,
    model_name: str = "model",
) -> DataFrame:
    """Candidate answers from a user's model, plus an ``error`` column.

    A model that is large to send or slow to start is given as ``load``, which
    is called once per Python worker and ``model_name``.

    ``prompts`` is what ``render_prompts`` gives. A prompt that stays without
    an answer until its deadline gets a null answer and an error; it does not
    fail the task. Questions of any id type are supported.
    """
    id_type = prompts.schema["question_id"].dataType.simpleString()
    schema = (
        f"question_id {id_type}, group_no int, answer string, source string, "
        "output_metadata string, vector_doc string, error string"
    )

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = model if load is None else loaded(model_name, load)
        for batch in batches:
            asked = [ask_with_retry(ask, p, busy, timeout_sec, pause_sec) for p in batch["prompt"]]
            yield pd.DataFrame(
                {
                    "question_id": batch["question_id"],
                    "group_no": batch["group_no"],
                    "answer": [answer for answer, _, _ in asked],
                    "source": batch["source"],
                    "output_metadata": [metadata for _, metadata, _ in asked],
                    "vector_doc": batch["context"],
                    "error": [error for _, _, error in asked],
                }
            )

    # Prompts are small and slow to answer, so they are spread by number and
    # not by size.
    tasks = 2 * prompts.sparkSession.sparkContext.defaultParallelism
    given = prompts.select("question_id", "group_no", "source", "context", "prompt")
    return given.repartition(tasks, "question_id", "group_no").mapInPandas(answer, schema)


def first_good_answers(
    candidates: DataFrame, questions: DataFrame, phrases: Sequence[str] = NON_ANSWER_PHRASES
) -> DataFrame:
    """One answer record per question: of the first good group, or the fallback.

    Questions that retrieve nothing get the fallback too.
    """
    good = is_good_answer(F.col("answer"), phrases)
    record = F.struct(*ANSWER_FIELDS)
    first = (
        candidates.where(good)
        .groupBy("question_id")
        .agg(F.min_by(record, "group_no").alias("record"))
    )
    found = questions.select("question_id", "question").join(first, "question_id", "left")
    fallback = F.struct(
        *[F.lit(NO_ANSWER if name == "answer" else NOT_AVAILABLE).alias(name) for name in ANSWER_FIELDS]
    )
    return found.select(
        "question_id", "question", F.coalesce("record", fallback).alias("record")
    ).select("question_id", "question", "record.*")


def answer_in_rounds(
    prompts: DataFrame,
    questions: DataFrame,
    generate: Callable[[DataFrame], DataFrame],
    num_groups: int,
    phrases: Sequence[str] = NON_ANSWER_PHRASES,
) -> DataFrame:
    """``first_good_answers`` with no model call after a question's first good answer.

    Each round asks only the next group of the questions still open. Its answers
    are written, so that a model is not asked again when a later round or a lost
    executor needs them. ``error`` is the first error of a question's calls,
    whether or not a later one was answered.
    """
    prompts = written(prompts, "prompts")
    open_questions = questions.select("question_id")
    asked = None
    for group_no in range(num_groups):
        turn = prompts.where(F.col("group_no") == group_no).join(open_questions, "question_id", "left_semi")
        candidates = written(generate(turn), "answers")
        asked = candidates if asked is None else asked.unionByName(candidates)
        good = candidates.where(is_good_answer(F.col("answer"), phrases))
        open_questions = open_questions.join(good, "question_id", "left_anti")
    answers = first_good_answers(asked, questions, phrases)
    if "error" not in asked.columns:
        return answers
    errors = asked.where("error is not null").groupBy("question_id").agg(F.min_by("error", "group_no").alias("error"))
    return answers.join(errors, "question_id", "left")


def answer_view(answers: DataFrame) -> DataFrame:
    """What a reader is shown: question, answer, supporting text, source."""
    return answers.select("question_id", "question", "answer", "vector_doc", "source")
