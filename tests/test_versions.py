"""Versions of an index: published in one step, added to, counted once, compacted, cleaned up."""

import numpy as np
import pyarrow as pa
import pytest

from folioseek.operators import index as idx
from folioseek.operators.embedders import HashedTerms, SparseScorer, UserVectors
from folioseek.operators.index import add_to_index, build_index, compact_index, drop_unused, indexed_chunks, new_segment, open_index
from folioseek.operators.postings import BlockSearch, inverted
from folioseek.operators.retrieval import BestRows
from folioseek.sources import versions
from folioseek.sources.scratch import fresh_path
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, full_text string"
QUESTIONS = [(1, "w1 w2 common"), (2, "w7 rare"), (3, "w30")]


def corpus(spark, low, high):
    rows = [(i, "s", f"w{i} w{i + 1} common " + ("rare " if i % 7 == 0 else "") + "filler " * (i % 5) + ("w2" if i >= 9 else "")) for i in range(low, high)]
    return spark.createDataFrame(rows, SCHEMA)


def found(index, spark, k=4):
    questions = spark.createDataFrame(QUESTIONS, "question_id long, question string")
    return sorted(tuple(r) for r in index.retrieve_texts(questions, k).select("question_id", "rank", "score", "doc_id", "text").collect())


def statistics(spark, index):
    return sorted(tuple(r) for r in spark.read.parquet(f"{index.path}/{index.meta['statistics']}").collect())


def test_added_segments_equal_one_build(spark):
    path, embedder = fresh_path(spark, "index"), HashedTerms()
    for number, (low, high) in enumerate([(0, 5), (5, 9), (9, 60)]):
        added = add_to_index(indexed_chunks(corpus(spark, low, high), embedder), path, embedder, new_segment("stream", number))
    whole = build_index(corpus(spark, 0, 60), fresh_path(spark, "index"))
    assert (added.version, len(added.meta["segments"]), added.meta["num_chunks"]) == (3, 3, 60)
    assert statistics(spark, added) == statistics(spark, whole)
    assert found(added, spark) == found(whole, spark)
    # Bounds of the first segments were made with other weights.
    assert added.meta["segments"][0]["slack"] > 1 and added.meta["segments"][2]["slack"] == 1

    # A batch that comes again is not counted again.
    again = add_to_index(indexed_chunks(corpus(spark, 9, 60), embedder), path, embedder, new_segment("stream", 2))
    assert (again.version, again.meta) == (added.version, added.meta)

    compact = compact_index(open_index(spark, path))
    assert (compact.version, len(compact.meta["segments"])) == (4, 1)
    assert statistics(spark, compact) == statistics(spark, whole) and found(compact, spark) == found(whole, spark)
    with pytest.raises(versions.VersionTaken):
        compact_index(added)

    # Readers of the version before go on until its folders are dropped.
    assert found(added, spark) == found(whole, spark)
    dropped = drop_unused(spark, path)
    assert {str(part["id"]) for part in added.meta["segments"]} <= set(dropped)
    assert found(open_index(spark, path), spark) == found(whole, spark)
    with pytest.raises(Exception):
        found(added, spark)


def test_a_build_that_dies_leaves_the_old_index(spark, monkeypatch):
    path = fresh_path(spark, "index")
    old = build_index(corpus(spark, 0, 9), path)
    before = found(old, spark)

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(idx, "make_postings", fail)
    with pytest.raises(RuntimeError, match="lost"):
        build_index(corpus(spark, 20, 50), path)
    monkeypatch.undo()
    monkeypatch.setattr(versions, "publish", fail)
    with pytest.raises(RuntimeError, match="lost"):
        build_index(corpus(spark, 20, 50), path)
    monkeypatch.undo()
    assert open_index(spark, path).version == 1 and found(open_index(spark, path), spark) == before


def test_a_reader_keeps_its_version_during_a_rebuild(spark):
    path = fresh_path(spark, "index")
    reader = build_index(corpus(spark, 0, 9), path)
    before = found(reader, spark)
    rebuilt = build_index(corpus(spark, 20, 50), path)
    assert found(reader, spark) == before != found(rebuilt, spark)
    assert open_index(spark, path).version == rebuilt.version == 2


def test_a_faster_writer_is_built_upon(spark, monkeypatch):
    path, embedder = fresh_path(spark, "index"), HashedTerms()
    publish, calls = versions.publish, []

    def late(session, where, number, content):
        calls.append(number)
        if len(calls) == 1:  # another writer comes first
            monkeypatch.setattr(versions, "publish", publish)
            add_to_index(indexed_chunks(corpus(spark, 0, 9), embedder), path, embedder)
            monkeypatch.setattr(versions, "publish", late)
        publish(session, where, number, content)

    monkeypatch.setattr(versions, "publish", late)
    added = add_to_index(indexed_chunks(corpus(spark, 9, 30), embedder), path, embedder)
    assert (calls, added.version, added.meta["num_chunks"]) == ([1, 2], 2, 30)
    assert found(added, spark) == found(build_index(corpus(spark, 0, 30), fresh_path(spark, "index")), spark)


def test_a_number_is_published_once(spark):
    path = fresh_path(spark, "versions")
    assert versions.current(spark, path) == (0, None)
    versions.publish(spark, path, 1, {"a": "é"})
    with pytest.raises(versions.VersionTaken):
        versions.publish(spark, path, 1, {"a": 2})
    versions.publish(spark, path, 2, {"a": 3})
    assert versions.current(spark, path) == (2, {"a": 3}) and versions.read(spark, path, 1) == {"a": "é"}
    assert versions.drop_versions(spark, path, 1) == [2]


def test_vectors_of_two_embedders_do_not_mix(spark):
    path = fresh_path(spark, "index")
    build_index(corpus(spark, 0, 3), path, embedder=HashedTerms(dim=512))
    with pytest.raises(ValueError, match="holds vectors"):
        add_to_index(indexed_chunks(corpus(spark, 3, 6), HashedTerms()), path, HashedTerms())


def test_dense_vectors_can_be_added(spark):
    embedder, path = UserVectors("size", 1, lambda texts: [[len(text)] for text in texts]), fresh_path(spark, "index")
    for low, high in ((0, 4), (4, 8)):
        added = add_to_index(indexed_chunks(corpus(spark, low, high), embedder), path, embedder)
    whole = build_index(corpus(spark, 0, 8), fresh_path(spark, "index"), embedder=embedder)
    assert found(added, spark) == found(whole, spark)


def test_texts_are_read_from_few_files_and_row_groups(spark, monkeypatch):
    monkeypatch.setattr(idx, "ROWS_PER_FILE", 64)
    monkeypatch.setattr(idx, "SLOT_BITS", 6)
    rows = spark.range(2000).select("id", F.lit("s"), F.format_string("t%d u%d filler text", "id", F.col("id") % 9)).toDF("doc_id", "source", "full_text")
    index = build_index(rows.repartition(4), fresh_path(spark, "index"))
    hits = index.retrieve_texts(spark.createDataFrame([(1, "t3"), (2, "t1999")], "question_id long, question string"), k=1)
    assert sorted((r["doc_id"], r["text"]) for r in hits.collect()) == [(3, "t3 u3 filler text"), (1999, "t1999 u1 filler text")]
    assert len([f for f in hits.inputFiles() if "/chunks/" in f]) <= 2 < 30 <= len(index.chunks.inputFiles())


@pytest.mark.parametrize("rows", [[5], [5, 6], [1, 2, 3, 900, 901, 2**40], list(range(0, 500, 5))])
def test_ranges_hold_all_rows_and_little_else(spark, rows):
    condition = idx._in_ranges(np.array(rows), 4)
    frame = spark.createDataFrame([(i,) for i in {*rows, *range(1000), 2**39}], "row long")
    kept = {r["row"] for r in frame.where(condition).collect()}
    assert set(rows) <= kept and (len(rows) > 10 or kept == set(rows))


def blocks_of(vectors, weights, size):
    parts = []
    for top in range(0, len(vectors), size):
        own = vectors[top : top + size]
        rows = pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), pa.array(range(top, top + len(own)), pa.int64())], ["vec", "row"])
        block = inverted(rows, "vec", {"row": "bigint"}, weights)
        parts.append(block.append_column("segment", pa.array([7] * len(block), pa.int64())))
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("slack", [1.0, 3.0])
def test_block_search_equals_all_pairs(seed, slack):
    rng = np.random.default_rng(seed)
    vectors = [np.sort(rng.zipf(1.4, rng.integers(0, 40)) % 300).tolist() for _ in range(900)]
    vectors[300:400] = [vectors[0]] * 100  # equal scores
    questions = [np.sort(rng.zipf(1.4, rng.integers(0, 9)) % 300) for _ in range(12)]
    weights = rng.integers(1, 9, 300) ** 2
    built_with = weights if slack == 1 else np.maximum(1, weights // 4)
    scorer, ids = SparseScorer(questions, weights), np.arange(900)
    expected = BestRows(12, 5, 0.0)
    for top, scores in scorer.tiles(pa.array(vectors, pa.list_(pa.int32()))):
        expected.add(scores, [ids[top : top + len(scores)]])
    widening = {7: float(np.sqrt(max(1, (built_with / weights).max())))}
    search = BlockSearch(scorer, 5, widening)
    whole = blocks_of(vectors, built_with, 16)
    for top in range(0, len(whole), 10):
        search.add(whole.slice(top, 10), ["row"])
    search.best.flush()
    rank = lambda best: sorted(zip(best.question.tolist(), np.round(best.score, 12).tolist(), best.ids[0].tolist()))
    assert rank(search.best) == rank(expected)


def test_blocks_that_cannot_win_are_skipped():
    rng = np.random.default_rng(1)
    vectors = [np.sort(np.append(rng.integers(0, 30, 20), 40 + i // 64)).tolist() for i in range(6400)]
    questions = [np.array([40 + q]) for q in range(5)] + [np.array([0, 1, 2, 40 + 50])]
    search = BlockSearch(SparseScorer(questions, np.where(np.arange(200) < 40, 1, 100)), 5, {})
    search.add(blocks_of(vectors, np.where(np.arange(200) < 40, 1, 100), 64), ["row"])
    search.best.flush()
    assert search.bounded >= 100 and search.skipped > 0.8 * search.bounded
    assert search.scored < 0.1 * len(vectors) * len(questions)
