from types import SimpleNamespace
from uuid import uuid4

import pytest

from folioseek.config import MODELS
from folioseek.plans.evaluation import log_evaluation, run_parameters
from folioseek.operators.layout import flatten_layout
from folioseek.sources import files, scratch
from folioseek.sources.files import (
    analyze_layout,
    decode_pages,
    layout_rows,
    raw_corpus,
    read_binary,
    read_text_documents,
)
from folioseek.sources.scratch import fresh_path, shared_folder
from folioseek.sources.tables import ensure_questions, project_corpus, save_corpus, use_database


@pytest.fixture
def database(spark):
    before = spark.catalog.currentDatabase()
    name = f"t_{uuid4().hex}"
    use_database(spark, name, fresh_path(spark, name))
    yield name
    spark.catalog.setCurrentDatabase(before)


def test_database_becomes_current(spark, database):
    assert spark.catalog.currentDatabase() == database
    use_database(spark, database)  # there already


def test_corpus_table_is_replaced_with_its_schema(spark, database):
    first = spark.createDataFrame([("t", "s", 1)], "full_text string, source string, page int")
    assert save_corpus(first, "corpus").columns == ["full_text", "source", "page"]
    second = spark.createDataFrame([("u", "s"), ("v", "s")], "full_text string, source string")
    saved = save_corpus(second, "corpus")
    assert saved.columns == ["full_text", "source"] and saved.count() == 2
    assert project_corpus(saved).columns == ["full_text", "source"]


def test_questions_are_written_once(spark, database):
    first = spark.createDataFrame([(1, "a")], "question_id long, question string")
    second = spark.createDataFrame([(2, "b"), (3, "c")], "question_id long, question string")
    assert ensure_questions(first, "eval_questions").collect() == ensure_questions(second, "eval_questions").collect()


def test_evaluations_are_appended_per_run(spark, database):
    answers = spark.createDataFrame([("q", "a", "s")], "question string, answer string, source string")
    models = list(MODELS.values())
    log_evaluation(answers, models[:1], "eval_log")
    log = log_evaluation(answers, models, "eval_log")
    assert log.count() == 1 + len(models)
    one_run = log.where(log["run_name"] == models[1].model_id)
    assert [(r["questions"], r["outputs"], r["template"]) for r in one_run.collect()] == [("q", "a", models[1].template)]
    assert "PartitionFilters: [isnotnull(run_name" in one_run._jdf.queryExecution().executedPlan().toString()


def test_run_parameters_describe_model_and_dataset(spark):
    questions = spark.createDataFrame([(1, "a"), (2, "b")], "question_id long, question string")
    rows = run_parameters(questions, "set", [MODELS["openai"], MODELS["mpt-30b-chat"]]).collect()
    found = {(r["run_name"], r["key"]): r["value"] for r in rows}
    assert found["openai", "temperature"] == "0.15"
    assert found["mpt-30b-chat", "max_new_tokens"] == "256"
    assert ("openai", "max_new_tokens") not in found
    assert found["openai", "dataset_rows"] == "2" and found["openai", "dataset"] == "set"
    again = run_parameters(questions.orderBy("question_id", ascending=False), "set", [MODELS["openai"]]).collect()
    assert {r["key"]: r["value"] for r in again}["dataset_digest"] == found["openai", "dataset_digest"]


def test_files_in_sub_folders_become_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.bin").write_bytes("p0|p1é".encode())
    (tmp_path / "sub" / "two.bin").write_bytes(b"x")
    (tmp_path / "skip.txt").write_text("other")
    found = read_binary(spark, str(tmp_path), "*.bin")
    pages = decode_pages(found, lambda content: content.decode().split("|"), batch_files=1)
    rows = sorted((r["source"].rsplit("/", 1)[-1], r["page"], r["full_text"]) for r in pages.collect())
    assert rows == [("one.bin", 0, "p0"), ("one.bin", 1, "p1é"), ("two.bin", 0, "x")]


def test_text_files_are_whole_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("l1\nl2")
    documents = read_text_documents(spark, str(tmp_path))
    row = documents.first()
    assert row["full_text"] == "l1\nl2" and row["source"].endswith("sub/a.txt") and row["page"] is None
    pages = spark.createDataFrame([("t", "s", 3)], "full_text string, source string, page int")
    assert raw_corpus(False, documents.drop("page"), pages).first()["page"] == 3
    assert raw_corpus(True, documents.drop("page"), pages).first()["page"] is None


def test_layout_service_results_become_a_corpus(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"Head|x|y")

    def analyze(content):
        head, *cells = content.decode().split("|")
        return {
            "paragraphs": [{"role": None, "content": head}, {"role": "pageFooter", "content": "1"}],
            "cells": [
                {"table_idx": 0, "cell_idx": i, "row_index": 0, "column_index": i, "kind": "content", "content": text}
                for i, text in enumerate(cells)
            ],
        }

    layouts = analyze_layout(read_binary(spark, str(tmp_path), "*.pdf"), analyze)
    text = flatten_layout(*layout_rows(layouts)).first()
    assert text["doc_id"].endswith("a.pdf")
    assert text["full_text"] == (
        "Head\nBelow is a Table:\nCell[0][0] has text 'x'\nCell[0][1] has text 'y'\n"
    )


def test_only_small_inputs_are_spread(spark, tmp_path, monkeypatch):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert files.spare_cores(one) == cores
    assert files.spare_cores(spark.range(10)) is None  # not read from files
    monkeypatch.setattr(files, "SPLIT_BYTES", 1)
    assert files.spare_cores(one) is None
    spark.range(100).repartition(2 * cores).write.parquet(str(tmp_path / "many"))
    assert files.spare_cores(spark.read.parquet(str(tmp_path / "many"))) is None


class FakeSession:
    def __init__(self, master, folder):
        self.sparkContext = SimpleNamespace(master=master, applicationId=f"app-{uuid4().hex}")
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}


def test_shared_folder_comes_from_the_session():
    assert shared_folder(FakeSession("spark://x", "/shared/")) == "/shared"
    with pytest.raises(RuntimeError):
        shared_folder(FakeSession("spark://x", None))


def test_a_local_session_gets_a_folder_of_its_own(tmp_path, monkeypatch):
    monkeypatch.setattr(scratch.tempfile, "mkdtemp", lambda prefix: str(tmp_path))
    session = FakeSession("local[2]", None)
    assert shared_folder(session) == shared_folder(session) == str(tmp_path)


def test_two_threads_log_two_runs_and_the_session_stays_as_it_was(spark, database):
    from concurrent.futures import ThreadPoolExecutor

    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    answers = spark.createDataFrame([("q", "a", "s"), ("r", "b", "s")], "question string, answer string, source string")
    models = list(MODELS.values())
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: log_evaluation(answers, models[:2], f"{database}.logs", f"run {i}"), range(3)))
    log_evaluation(answers, models[:2], f"{database}.logs", "run 1")  # replaces its own rows
    log = spark.table(f"{database}.logs")
    counted = {(r["run_id"], r["run_name"]): r["count"] for r in log.groupBy("run_id", "run_name").count().collect()}
    assert counted == {(f"run {i}", m.model_id): 2 for i in range(3) for m in models[:2]}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
