"""Every registered query against its SQL, and the shape of its plan."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registered
from check import canonical
from conftest import SF_DIR
from workload.oracle import ORACLE_SQL
from workload.queries import QUERIES as workload_queries

# The library's own queries; those of the llm folder, where it is present, have tests beside theirs.
QUERIES = {name: registered.queries()[name] for name in workload_queries}
NATIVE = [
    "page_split",
    "corpus_project",
    "corpus_count",
    "longest_document",
    "chunk_documents",
    "chunk_metadata",
    "layout_flatten",
    "embed_hashed",
    "question_prefix",
    "answer_screen",
    "chat_history",
]


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(ORACLE_SQL) == set(QUERIES) and set(QUERIES) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, database, name):
    frame = QUERIES[name](spark, SF_DIR)
    result = database.execute(registered.oracle_sql()[name])
    columns = [column[0] for column in result.description]
    assert sorted(frame.columns) == sorted(columns)
    rows = [tuple(row) for row in frame.collect()]
    assert rows
    assert canonical(rows, frame.columns) == canonical(result.fetchall(), columns)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for wrong in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert wrong not in plan


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_start_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "MapInPandas" not in plan


def test_only_needed_columns_are_read(spark):
    plan = QUERIES["corpus_project"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,source:string>" in plan


def test_questions_find_the_documents_that_hold_them(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    texts = [(row["doc_id"], row["text"]) for row in documents.collect()]
    held = {
        row["item_id"]: {doc_id for doc_id, text in texts if row["text"] in text} for row in benchmark.collect()
    }
    first = QUERIES["retrieve_sparse"](spark, SF_DIR).where("rank = 1").collect()
    found = {row["question_id"]: row["doc_id"] for row in first}
    known = {item for item, ids in held.items() if ids}
    assert known and all(found[item] in held[item] for item in known)


def test_entry(spark):
    frame = registered.entry(spark)
    assert frame.count() > 0
