"""The registered queries of the llm folder against their SQL, and the shape of their plans."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registered
from check import canonical
from conftest import SF_DIR
from folioseek.llm.oracle import ORACLE_SQL
from folioseek.llm.queries import QUERIES

NATIVE = ["op2_quality_rules", "op8_host_graph", "op9_surrogates"]
WITHOUT_SQL = {"op3_license_automaton", "op6_benchmark_leaks", "op7_trie_scores", "op9_surrogates", "op10_compressed_language"} | {"op11_simhash_near_dedup", "op13_token_alignment"}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_all_operators_and_the_pipeline_are_registered():
    names = registered.queries()
    assert "pipeline" in names and set(QUERIES) <= set(names)
    assert {name.split("_")[0] for name in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) - set(ORACLE_SQL) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, database, name):
    frame = registered.queries()[name](spark, SF_DIR)
    result = database.execute(ORACLE_SQL[name])
    columns = [column[0] for column in result.description]
    assert sorted(frame.columns) == sorted(columns)
    rows = [tuple(row) for row in frame.collect()]
    assert rows and canonical(rows, frame.columns) == canonical(result.fetchall(), columns)


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_start_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "MapInArrow", "MapInPandas", "ExistingRDD", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
