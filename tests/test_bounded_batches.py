"""What one task holds at a time does not grow with the table."""

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
from pyspark.sql import DataFrameWriter

from folioseek.config import ChunkSettings
from folioseek.operators import index as idx, postings, retrieval
from folioseek.operators.chunking import chunk_with_tokenizer
from folioseek.operators.embedders import HashedTerms, SparseScorer
from folioseek.operators.postings import BlockSearch
from folioseek.sources.session import BATCH_ROWS, SCANNED_ROWS, small_batches, small_scans
from test_versions import blocks_of
from workload import fixtures


def test_postings_are_written_in_small_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idx, "ROW_GROUP_BYTES", 1 << 16)
    corpus = spark.range(0, 26000, 1, 1).selectExpr("id AS doc_id", "'s' AS source", "concat('w', id, ' v', id % 7) AS full_text")
    idx.build_index(corpus, str(tmp_path / "index"), embedder=HashedTerms(dim=4096))
    files = ds.dataset(next((tmp_path / "index" / "segments").glob("*/postings"))).get_fragments()
    groups = [group.num_rows for file in files for group in file.row_groups]
    assert sum(groups) >= 26000 // 64 and max(groups) <= 200


@pytest.mark.parametrize("cells", [1, 50, 1 << 20])
def test_steps_of_a_search_are_bounded_by_entries(monkeypatch, cells):
    rng = np.random.default_rng(2)
    vectors = [np.sort(rng.integers(0, 90, 30)).tolist() for _ in range(320)]
    questions = [np.sort(rng.integers(0, 90, 4)) for _ in range(9)] + [np.array([95])]
    scorer = SparseScorer(questions, np.ones(100, np.int64))
    blocks, seen = blocks_of(vectors, np.ones(100, np.int64), 16), []

    def searched():
        search = BlockSearch(scorer, 5, {})
        search.add(blocks, ["row"])
        search.best.flush()
        return sorted(zip(search.best.question.tolist(), search.best.score.tolist(), search.best.ids[0].tolist()))

    expected = searched()
    monkeypatch.setattr(postings, "STEP_CELLS", cells)
    add = BlockSearch._add
    monkeypatch.setattr(BlockSearch, "_add", lambda self, part, ids: (seen.append((len(part), len(part.column("chunk").flatten()))), add(self, part, ids)))
    assert searched() == expected
    assert sum(rows for rows, _ in seen) == len(blocks)
    assert all(rows == 1 or entries <= cells for rows, entries in seen)


def test_chunks_of_a_tokenizer_are_python_values_a_few_at_a_time(spark):
    class Counted(str):
        alive = 0

        def __new__(cls, value):
            Counted.alive += 1
            return super().__new__(cls, Counted.alive)

        def __del__(self):
            Counted.alive -= 1

    documents = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "'abcdef' AS full_text")
    chunks = chunk_with_tokenizer(documents, list, Counted, settings=ChunkSettings(3, 0)).collect()
    assert len(chunks) == 4000
    assert max(int(row["text"]) for row in chunks) < 1000


def test_documents_are_packed_into_few_files(spark, tmp_path, monkeypatch):
    rows = [(i, f"t{i}\nü:\f ") for i in range(500)] + [(7, "again"), (500, None), (501, ""), (-3, "x"), (None, "y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    paths = []
    monkeypatch.setattr(fixtures, "fresh_path", lambda spark, name: paths.append(str(tmp_path / name)) or paths[-1])
    found = {(row["source"], bytes(row["content"]).decode()) for row in fixtures.document_files(spark, str(tmp_path)).collect()}
    expected = {(f"file-{i}", f"t{i}\nü:\f \f") for i in range(500) if i != 7}
    expected |= {("file-500", "\f"), ("file-501", "\f"), ("file-", "x\f"), ("file-", "y\f")}
    assert found - expected == {("file-7", "again\ft7\nü:\f \f")} and expected <= found
    assert len(list((tmp_path / "files").rglob("*.txt"))) < 40


def test_a_search_hands_few_blocks_to_python_at_a_time(spark, tmp_path, monkeypatch):
    corpus = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "'s' AS source", "concat('w', id, ' v', id % 7) AS full_text")
    index = idx.build_index(corpus, str(tmp_path / "index"), embedder=HashedTerms(dim=4096))
    questions = spark.createDataFrame([(1, "w5 v3"), (2, "w77")], "question_id long, question string")
    before, write, seen = spark.conf.get(BATCH_ROWS), retrieval.written, []
    monkeypatch.setattr(retrieval, "written", lambda df, name: (seen.append((name, spark.conf.get(BATCH_ROWS))), write(df, name))[1])
    rows = index.retrieve(questions, k=2).where("rank = 1").orderBy("question_id").collect()
    assert [row["doc_id"] for row in rows] == [5, 77]
    assert ("hits", str(postings.BATCH_BLOCKS)) in seen and postings.BATCH_BLOCKS <= 64
    assert spark.conf.get(BATCH_ROWS) == before


def test_small_batches_end_with_the_last_that_needs_them(spark):
    before = spark.conf.get(BATCH_ROWS)
    first, second = small_batches(spark, 8), small_batches(spark, 8)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    sizes = spark.range(0, 50, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(batch)]}) for batch in batches), "n long")
    assert sizes.agg({"n": "max"}).first()[0] == 8
    second.__exit__(None, None, None)
    assert spark.conf.get(BATCH_ROWS) == before
    with small_batches(spark, None):
        assert spark.conf.get(BATCH_ROWS) == before


def test_large_rows_are_decoded_a_few_at_a_time(spark, tmp_path, monkeypatch):
    before, write, seen = spark.conf.get(SCANNED_ROWS), DataFrameWriter.parquet, {}

    def noted(self, path, *rest, **options):
        seen[path.split("/")[-1].split("-")[0]] = int(spark.conf.get(SCANNED_ROWS))
        return write(self, path, *rest, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    corpus = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "'s' AS source", "concat('w', id, ' v', id % 7) AS full_text")
    index = idx.build_index(corpus, str(tmp_path / "index"), embedder=HashedTerms(dim=4096))
    index.retrieve(spark.createDataFrame([(1, "w5 v3")], "question_id long, question string"), k=2)
    assert max(seen[name] for name in ("chunks", "statistics", "postings")) <= 512
    assert seen["hits"] == postings.BATCH_BLOCKS
    assert spark.conf.get(SCANNED_ROWS) == before


def test_postings_are_made_of_few_chunks_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idx, "SCAN_ROWS", 100)
    corpus = spark.range(0, 1000, 1, 1).selectExpr("id AS doc_id", "'s' AS source", "concat('w', id) AS full_text").coalesce(1)
    index = idx.build_index(corpus, str(tmp_path / "index"), embedder=HashedTerms(dim=4096))
    sizes = index._postings(1)[0].selectExpr("size(row) AS n", "explode(row) AS row").groupBy("n").count().collect()
    assert sum(row["count"] for row in sizes) == 1000
    # A batch of 100 chunks ends in a block of 36; of 10,000 there would be one short block a task.
    assert dict(sizes)[36] >= 36 * 4


def test_small_scans_do_not_change_what_goes_to_python(spark):
    rows, batch = spark.conf.get(SCANNED_ROWS), spark.conf.get(BATCH_ROWS)
    with small_scans(spark, 16), small_batches(spark, 8):
        assert (spark.conf.get(SCANNED_ROWS), spark.conf.get(BATCH_ROWS)) == ("8", "8")
    with small_scans(spark, 16):
        assert (spark.conf.get(SCANNED_ROWS), spark.conf.get(BATCH_ROWS)) == ("16", batch)
    assert (spark.conf.get(SCANNED_ROWS), spark.conf.get(BATCH_ROWS)) == (rows, batch)
