import time

import pytest
from pyspark.sql import functions as F

from folioseek.operators.answers import (
    NO_ANSWER,
    ModelBusy,
    answer_extractive,
    answer_in_rounds,
    ask_with_retry,
    first_good_answers,
    generate_answers,
    render_prompts,
    render_prompts_by_model,
)
from folioseek.config import MODELS
from folioseek.operators.chat import append_turns, chat_history
from folioseek.operators.contexts import context_groups, running_contexts, top_context

HITS = "question_id long, rank int, text string, source string"
CANDIDATES = "question_id long, group_no int, answer string, source string, output_metadata string, vector_doc string"


@pytest.fixture
def hits(spark):
    rows = [(1, rank, f"t{rank}", f"s{rank}") for rank in (10, 2, 7, 1, 3, 5, 4, 6, 9, 8)]
    return spark.createDataFrame(rows + [(2, 1, "only", "s")], HITS)


@pytest.fixture
def questions(spark):
    return spark.createDataFrame([(1, "one {context}"), (2, "two"), (3, "three")], "question_id long, question string")


def paragraphs(*texts):
    return "".join("\nParagraph: \n" + text for text in texts)


def test_ten_hits_make_groups_of_three_and_a_rest(hits):
    rows = {(r["question_id"], r["group_no"]): (r["context"], r["source"]) for r in context_groups(hits).collect()}
    assert rows == {
        (1, 0): (paragraphs("t1", "t2", "t3"), "s3"),
        (1, 1): (paragraphs("t4", "t5", "t6"), "s6"),
        (1, 2): (paragraphs("t7", "t8", "t9"), "s9"),
        (1, 3): (paragraphs("t10"), "s10"),
        (2, 0): (paragraphs("only"), "s"),
    }


def test_group_size_is_honoured(hits):
    assert context_groups(hits, 4).where("question_id = 1").count() == 3


def test_running_contexts_hold_earlier_groups(hits):
    rows = {(r["question_id"], r["group_no"]): r["context"] for r in running_contexts(hits).collect()}
    assert rows[1, 1] == paragraphs("t1", "t2", "t3", "t4", "t5", "t6")
    assert rows[1, 3] == paragraphs(*[f"t{i}" for i in range(1, 11)])


def test_top_context(hits):
    rows = {r["question_id"]: r["context"] for r in top_context(hits).collect()}
    assert rows == {1: paragraphs("t1", "t2", "t3"), 2: paragraphs("only")}


def test_extractive_answer(spark):
    questions = spark.createDataFrame([(1, "Red fox red"), (2, "zebra"), (3, "x")], "question_id long, question string")
    contexts = spark.createDataFrame(
        [
            (1, 0, paragraphs("A red car. The RED fox! A fox red"), "s"),
            (2, 0, paragraphs("A red car."), "s"),
            (3, 0, None, "s"),
        ],
        "question_id long, group_no int, context string, source string",
    )
    rows = {r["question_id"]: (r["answer"], r["output_metadata"]) for r in answer_extractive(contexts, questions).collect()}
    assert rows == {
        1: ("The RED fox", '{"shared_terms":2}'),
        2: ("I don't know", '{"shared_terms":0}'),
        3: ("I don't know", '{"shared_terms":0}'),
    }


def test_first_good_answer_and_fallback(spark, questions):
    candidates = spark.createDataFrame(
        [
            (1, 2, "late", "s2", "m", "d2"),
            (1, 0, "Sorry", "s0", "m", "d0"),
            (1, 1, "right", "s1", None, "d1"),
            (2, 0, "I don't know", "s", "m", "d"),
            (2, 1, None, "s", "m", "d"),
        ],
        CANDIDATES,
    )
    rows = {r["question_id"]: r for r in first_good_answers(candidates, questions).collect()}
    assert (rows[1]["answer"], rows[1]["source"], rows[1]["vector_doc"]) == ("right", "s1", "d1")
    assert rows[1]["output_metadata"] is None
    for question_id in (2, 3):  # no good group, nothing retrieved
        record = rows[question_id]
        assert record["answer"] == NO_ANSWER
        assert {record["source"], record["output_metadata"], record["vector_doc"]} == {"NA"}


def test_prompts_keep_braces(hits, questions):
    prompt = render_prompts(context_groups(hits), questions, "{context}|{question}").where(
        "question_id = 1 AND group_no = 3"
    )
    assert prompt.first()["prompt"] == paragraphs("t10") + "|one {context}"


def test_one_prompt_per_model_without_a_join(hits, questions):
    prompts = render_prompts_by_model(context_groups(hits), questions, list(MODELS.values()))
    assert prompts.count() == 5 * len(MODELS)
    assert prompts.select("model_id").distinct().count() == len(MODELS)


def test_retry_until_an_answer():
    calls = []

    def model(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise ModelBusy
        return "done", {"tokens": 3}

    assert ask_with_retry(model, "p", ModelBusy, 5, 0.01) == ("done", '{"tokens": 3}', None)
    assert len(calls) == 3


def test_retry_stops_at_the_deadline():
    def model(prompt):
        raise ModelBusy

    started = time.monotonic()
    answer, _, error = ask_with_retry(model, "p", ModelBusy, 0.2, 0.05)
    assert answer is None and "0.2 seconds" in error
    assert time.monotonic() - started < 2


def test_other_errors_are_raised():
    def model(prompt):
        raise ZeroDivisionError

    with pytest.raises(ZeroDivisionError):
        ask_with_retry(model, "p", ModelBusy, 1, 0.1)


def test_a_busy_model_does_not_fail_the_job(hits, questions):
    def model(prompt):
        if "only" in prompt:
            raise ModelBusy
        return f"seen {len(prompt)}"

    prompts = render_prompts(context_groups(hits), questions, "{context}{question}")
    rows = generate_answers(prompts, model, timeout_sec=0.1, pause_sec=0.05).collect()
    errors = {r["question_id"] for r in rows if r["error"]}
    assert errors == {2}
    assert all(r["answer"] is None for r in rows if r["error"])


def test_rounds_ask_only_open_questions(spark, hits, questions):
    asked = spark.sparkContext.accumulator(0)

    def model(prompt):
        asked.add(1)
        return "found it" if "t5" in prompt or "only" in prompt else "I don't know"

    prompts = render_prompts(context_groups(hits), questions, "{context}{question}")
    answers = answer_in_rounds(prompts, questions, lambda turn: generate_answers(turn, model), 4)
    rows = {r["question_id"]: r["answer"] for r in answers.collect()}
    assert rows == {1: "found it", 2: "found it", 3: NO_ANSWER}
    # Question 1 in groups 0 and 1, question 2 in group 0.
    assert asked.value == 3


def test_chat_history_pairs(spark):
    turns = spark.createDataFrame(
        [
            (1, 0, "system", "rules"),
            (1, 1, "user", "q1"),
            (1, 2, "assistant", "a1"),
            (1, 3, "user", "q2"),
            (2, 0, "user", "alone"),
            (2, 1, "user", "q"),
            (2, 2, "assistant", "a"),
        ],
        "conv_id long, turn long, role string, text string",
    )
    history = chat_history(turns)
    assert sorted(history.select("conv_id", "turn", "question", "answer").collect()) == [
        (1, 1, "q1", "a1"),
        (2, 1, "q", "a"),
    ]
    more = spark.createDataFrame([(1, 3, "q2", "a2")], "conv_id long, turn long, question string, answer string")
    assert append_turns(history, more.withColumn("extra", F.lit(1))).count() == 3
