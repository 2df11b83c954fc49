"""Cases outside the fixtures: close vectors, repeated ids and keys, errors, models, runs."""

import time

import pytest

from folioseek.config import MODELS, TEMPLATES, ChunkSettings
from folioseek.operators.answers import ModelBusy, answer_in_rounds, ask_with_retry, generate_answers
from folioseek.operators.embedders import HashedTerms, UserVectors, embedder_named, register_embedder
from folioseek.operators.index import build_index
from folioseek.operators.retrieval import nearest
from folioseek.plans.answering import answer_questions_with_model
from folioseek.plans.evaluation import log_evaluation
from folioseek.sources import scratch
from workload import fixtures


def test_close_vectors_are_ranked_before_rounding(spark):
    vectors = spark.createDataFrame([(i, [1e-4 * i, 0.0]) for i in range(8)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [7e-4, 0.0])], "question_id long, embedding array<double>")
    hits = nearest(asked, vectors, UserVectors("given", 2, column="embedding"), ids=["vec_id"], k=3).orderBy("rank")
    assert [r.vec_id for r in hits.collect()] == [7, 6, 5]


@pytest.mark.parametrize("rows", [[(7, "w3"), (7, "w5")], [(None, "w3")]])
def test_repeated_or_missing_question_ids_are_refused_at_any_size(spark, tmp_path, rows):
    corpus = spark.createDataFrame([(i, "s", f"w{i} w{i + 1}") for i in range(9)], "doc_id long, source string, full_text string")
    index = build_index(corpus, str(tmp_path / "index"))
    with pytest.raises(ValueError, match="unique"):
        index.retrieve(spark.createDataFrame(rows, "question_id long, question string"))


def test_pages_of_one_document_are_rows_of_their_own(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "s", "w1 w2"), (1, "s", "w1 w3 w4")], "doc_id long, source string, full_text string")
    index = build_index(corpus, str(tmp_path / "index"))
    rows = index.retrieve_texts(spark.createDataFrame([(1, "w1")], "question_id long, question string"), k=2).collect()
    assert sorted((r["rank"], r["text"]) for r in rows) == [(1, "w1 w2"), (2, "w1 w3 w4")]


def test_words_of_the_prefix_are_not_searched_for(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "s", "for this sentence"), (2, "s", "answer")], "doc_id long, source string, full_text string")
    index = build_index(corpus, str(tmp_path / "index"))
    rows = index.retrieve(spark.createDataFrame([(1, "answer")], "question_id long, question string")).collect()
    assert [r["doc_id"] for r in rows] == [2]


def test_a_call_that_hangs_ends_at_the_deadline():
    started = time.monotonic()
    answer, _, error = ask_with_retry(lambda prompt: time.sleep(30), "p", ModelBusy, 0.3, 0.05)
    assert answer is None and "0.3" in error and time.monotonic() - started < 5


def test_errors_reach_the_result(spark):
    prompts = spark.createDataFrame(
        [(1, 0, "s", "c", "busy"), (1, 1, "s", "c", "fine"), (2, 0, "s", "c", "busy"), (3, 0, "s", "c", "fine")],
        "question_id long, group_no int, source string, context string, prompt string",
    )
    questions = spark.createDataFrame([(i, f"q{i}") for i in range(1, 5)], "question_id long, question string")

    def model(prompt):
        if prompt == "busy":
            raise ModelBusy
        return "an answer"

    answers = answer_in_rounds(prompts, questions, lambda turn: generate_answers(turn, model, timeout_sec=0.1, pause_sec=0.05), 2)
    found = {r.question_id: (r.answer == "an answer", r.error) for r in answers.collect()}
    error = "no answer within 0.1 seconds"
    assert found == {1: (True, error), 2: (False, error), 3: (True, None), 4: (False, None)}


def test_models_are_loaded_once_per_worker(spark, tmp_path):
    log = tmp_path / "loads"

    def load():
        with open(log, "a") as out:
            out.write("x")
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    texts = spark.createDataFrame([(i, "t" * (i % 5)) for i in range(300)], "id long, text string").repartition(12)
    rows = UserVectors("loaded once", 2, load=load).vectorize(texts).collect()
    assert all(r.vec == [len(r.text), 1.0] for r in rows)
    # Four workers at most run the twelve tasks.
    assert len(log.read_text()) <= 4


def test_embedders_by_name(spark):
    register_embedder(MODELS["openai"].embedding_model, lambda: UserVectors("ada", 3, encode=lambda texts: [[0, 0, 0]] * len(texts)))
    assert embedder_named(MODELS["openai"].embedding_model).dim == 3 and embedder_named("hashed-terms") == HashedTerms()
    with pytest.raises(KeyError):
        embedder_named("unknown")


def test_templates_by_name(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "s", "w1 w2")], "doc_id long, source string, full_text string")
    index = build_index(corpus, str(tmp_path / "index"), ChunkSettings(4, 1))
    questions = spark.createDataFrame([(1, "w1")], "question_id long, question string")
    answers = answer_questions_with_model(questions, index, lambda prompt: str(len(prompt)), template="inst-exploratory").collect()
    prompt = TEMPLATES["inst-exploratory"].replace("{context}", answers[0].vector_doc).replace("{question}", "w1")
    assert answers[0].answer == str(len(prompt))


def test_a_repeated_run_replaces_its_rows(spark, tmp_path):
    spark.sql(f"CREATE DATABASE runs LOCATION '{tmp_path}/runs'")
    answers = spark.createDataFrame([("q", "a", "s")], "question string, answer string, source string")
    models = [MODELS["openai"], MODELS["mpt-30b-chat"]]
    log_evaluation(answers, models, "runs.log", "one")
    log_evaluation(answers, models, "runs.log", "two")
    log_evaluation(answers, models[:1], "runs.log", "two")
    log = log_evaluation(answers, models, "runs.log", "one")
    assert sorted((r.run_id, r.run_name) for r in log.collect()) == sorted((i, m.model_id) for i in ("one", "two") for m in models)


def test_paragraphs_are_whole(spark, tmp_path):
    html = "<body><p><b>Bold</b> and <i>more</i><br>text<p>second &amp; last</p><footer>foot <a href='/x'>li<b>n</b>k</a></footer></body>"
    spark.createDataFrame([(1, "u", html), (2, "u", "<p>open end"), (3, "u", "none")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = fixtures.page_paragraphs(spark, str(tmp_path)).orderBy("doc_id", "para_idx").collect()
    assert [(r.doc_id, r.role, r.content) for r in rows] == [
        (1, None, "Bold and more text"), (1, None, "second &amp; last"), (1, "pageFooter", "foot link"), (2, None, "open end"),
    ]
    assert [r.content for r in fixtures.page_cells(spark, str(tmp_path)).collect()] == ["link"]


def test_an_operation_drops_its_tables(spark):
    kept = scratch.written(spark.range(3).toDF("x"), "kept")
    with scratch.owned(spark):
        dropped = scratch.written(spark.range(3).toDF("x"), "dropped")
        (path,) = scratch._OPEN.stack[-1]
        assert dropped.count() == 3
    assert kept.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_each_model_is_logged_with_what_it_answered(spark, tmp_path):
    """Options reach the model, its embedder picks the index, and no model's answers stand under another's name."""
    from folioseek.config import ModelSettings
    from folioseek.plans.evaluation import EvaluatedModel, evaluate_models

    corpus = spark.createDataFrame([(1, "first", "alpha beta"), (2, "second", "alpha gamma gamma")], "doc_id long, source string, full_text string")
    register_embedder("words of a test", HashedTerms)
    register_embedder("lengths of a test", lambda: UserVectors("lengths", 1, lambda texts: [[-len(text)] for text in texts], prefix=""))
    indexes = {}
    for name in ("words of a test", "lengths of a test"):
        indexes[name] = str(tmp_path / name.split()[0])
        build_index(corpus, indexes[name], embedder=embedder_named(name))
    say = lambda options: lambda prompt: f"{options['word']} {prompt}"
    models = [
        EvaluatedModel(ModelSettings("a", "words of a test", "A {context} {question}", {"word": "yes"}), say),
        EvaluatedModel(ModelSettings("b", "lengths of a test", "B {context} {question}", {"word": "no"}), say),
    ]
    questions = spark.createDataFrame([(1, "alpha gamma gamma or")], "question_id long, question string")
    table = f"{fixtures.fresh_database(spark)}.runs"
    log = {r["run_name"]: r for r in evaluate_models(questions, models, indexes, table, "one", k=1).collect()}
    assert sorted(log) == ["a", "b"]
    assert log["a"]["outputs"].startswith("yes A") and log["b"]["outputs"].startswith("no B")
    assert log["a"]["source"] == log["b"]["source"] == "second" and log["b"]["template"] == "B {context} {question}"
    # The same run again replaces its rows.
    assert evaluate_models(questions, models, indexes, table, "one", k=1).count() == 2
