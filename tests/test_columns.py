import zlib

import pytest

from folioseek.config import MODELS, model_settings
from folioseek.functions.prompts import QUESTION_PREFIX, prefixed_question, render
from folioseek.functions.screening import EXPLORATORY_PHRASE, NON_ANSWER_PHRASES, is_good_answer
from folioseek.functions.text import clean_layout_text, drop_selection_marks, sentences, terms, tokens
from folioseek.functions.vectors import hashed_vector, term_frequencies, token_bucket


def test_tokens_split_on_whitespace_runs(column_value):
    assert column_value(tokens, text=" a\n\nb\tc  d\r") == ["a", "b", "c", "d"]
    assert column_value(tokens, text=" \n ") == []
    assert column_value(tokens, text=None) == []


def test_terms_are_lower_case_and_distinct(column_value):
    assert column_value(terms, text="The the É é THE") == ["the", "é"]


def test_layout_text_is_cleaned(column_value):
    assert column_value(clean_layout_text, text="  :selected: a\nb :unselected: \n") == "ab"
    assert column_value(drop_selection_marks, text=":selected: a\nb ") == " a\nb "


def test_sentences_are_trimmed_and_never_empty(column_value):
    assert column_value(sentences, text="One. Two!?\n\n Three") == ["One", "Two", "Three"]


@pytest.mark.parametrize("phrase", NON_ANSWER_PHRASES)
def test_each_phrase_is_rejected_in_any_case(column_value, phrase):
    assert column_value(is_good_answer, text=f"Well, {phrase.upper()} here") is False


@pytest.mark.parametrize(
    ("answer", "good"),
    [
        (None, False),
        ("", False),
        ("Is it so?", False),
        ("? not at the end", True),
        ("the unsorryness of it", False),  # a phrase inside a longer word
        ("I can answer the following questions", True),  # never part of the list
        ("it is not explicitly said", True),
        ("Ten years.", True),
    ],
)
def test_answer_screen(column_value, answer, good):
    assert column_value(is_good_answer, text=answer) is good


def test_phrase_list_is_a_parameter(column_value):
    longer = (*NON_ANSWER_PHRASES, EXPLORATORY_PHRASE)
    assert column_value(lambda text: is_good_answer(text, longer), text="it is not explicitly said") is False


def test_question_prefix(column_value):
    assert column_value(prefixed_question, text="why") == QUESTION_PREFIX + "why"


def test_braces_in_values_are_text(column_value):
    rendered = lambda c, q: render("[{context}] {question} ?", context=c, question=q)
    value = column_value(rendered, c="{question} {context}", q="{context}")
    assert value == "[{question} {context}] {context} ?"


def test_model_settings_with_and_without_owner():
    assert model_settings("meta-llama/Llama-2-13b-chat-hf") is MODELS["Llama-2-13b-chat-hf"]
    assert model_settings("openai").options["temperature"] == "0.15"
    with pytest.raises(KeyError):
        model_settings("unknown")
    for settings in MODELS.values():
        assert "Given the context: {context}. Answer the question {question}" in settings.template


@pytest.mark.parametrize("token", ["a", "é", "word", "日本語"])
def test_bucket_is_crc32(column_value, token):
    assert column_value(token_bucket, text=token) == zlib.crc32(token.encode()) % 2**18


def test_hashed_vector_counts_terms(column_value):
    frequencies = column_value(lambda text: term_frequencies(hashed_vector(tokens(text))), text="b a b c b a")
    buckets = {word: column_value(token_bucket, text=word) for word in "abc"}
    assert {row["bucket"]: row["tf"] for row in frequencies} == {
        buckets["a"]: 2,
        buckets["b"]: 3,
        buckets["c"]: 1,
    }
    assert column_value(lambda text: term_frequencies(hashed_vector(tokens(text))), text="") == []
