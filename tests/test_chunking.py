import random

import pytest

from folioseek.config import ChunkSettings
from folioseek.operators import chunking
from folioseek.operators.chunking import _chunks_of_pieces, chunk_blocks, chunk_documents, chunk_metadata, chunk_with_tokenizer
from folioseek.operators.pages import longest_document, split_pages


def windows(words, settings):
    starts = range(0, len(words), settings.step)
    return [words[at : at + settings.size] for at in starts]


@pytest.mark.parametrize("n", [0, 1, 6, 7, 8, 9, 10, 16, 29])
def test_windows_match_plain_slices(spark, n):
    settings = ChunkSettings(8, 2)
    words = [f"w{i}" for i in range(n)]
    documents = spark.createDataFrame([(1, "s", "  \n".join(words))], "doc_id long, source string, full_text string")
    rows = sorted(chunk_documents(documents, settings=settings).collect(), key=lambda row: row["chunk_no"])
    expected = [" ".join(window) for window in windows(words, settings)]
    assert [row["text"] for row in rows] == expected
    assert [row["chunk_no"] for row in rows] == list(range(len(expected)))
    assert {row["num_chunks"] for row in rows} <= {len(expected)}


@pytest.mark.parametrize("seed", range(3))
def test_blocks_give_the_chunks_of_the_whole_text(spark, seed):
    rng = random.Random(seed)
    blocks = []
    for doc in range(4):
        for at in range(rng.randint(1, 30)):
            words = [f"{doc}.{at}.{i}" for i in range(rng.choice([0, 1, 2, 9, 40]))]
            blocks.append((doc, at // 5, at % 5, "\n".join(words) + "\n"))
    texts = {}
    for doc, _, _, text in blocks:
        texts[doc] = texts.get(doc, "") + text
    rng.shuffle(blocks)
    settings = ChunkSettings(8, 3)
    frame = spark.createDataFrame(blocks, "doc_id long, major int, minor int, text string")
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, full_text string")
    whole = chunk_documents(documents, settings=settings)
    cut = chunk_blocks(frame, ["major", "minor"], settings=settings)
    assert sorted(cut.collect()) == sorted(whole.select(*cut.columns).collect())


def test_null_text_has_no_chunks(spark):
    documents = spark.createDataFrame([(1, None)], "doc_id long, full_text string")
    assert chunk_documents(documents).count() == 0


def test_overlap_must_be_below_size():
    with pytest.raises(ValueError):
        ChunkSettings(10, 10)


def test_user_tokenizer_agrees_with_words(spark):
    settings = ChunkSettings(5, 1)
    documents = spark.createDataFrame(
        [(1, "a b c d e f g h i j"), (2, ""), (3, None)], "doc_id long, full_text string"
    )
    native = chunk_documents(documents, settings=settings).collect()
    python = chunk_with_tokenizer(documents, str.split, " ".join, settings=settings).collect()
    assert sorted(native) == sorted(python)


def test_user_tokenizer_runs_once(spark):
    documents = spark.createDataFrame([(1, "a b")], "doc_id long, full_text string")
    plan = chunk_with_tokenizer(documents, str.split, " ".join)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_windows_are_computed_once(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("text", "full_text")
    plan = chunk_documents(documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_join") == 1
    assert "Exchange" not in plan


def test_metadata_leaves_out_text_and_count(spark):
    documents = spark.createDataFrame([(1, "s1", "a b")], "doc_id long, source string, full_text string")
    assert chunk_metadata(chunk_documents(documents)).first()["metadata"] == {"source": "s1"}


def test_pages_by_lines_and_by_mark(spark):
    text = "\n".join(str(i) for i in range(5))
    documents = spark.createDataFrame([(1, text), (2, "a\fb")], "doc_id long, text string")
    by_lines = {(r["doc_id"], r["page"]): r["full_text"] for r in split_pages(documents, lines_per_page=2).collect()}
    assert by_lines == {(1, 0): "0\n1", (1, 1): "2\n3", (1, 2): "4", (2, 0): "a\fb"}
    by_mark = {(r["doc_id"], r["page"]): r["full_text"] for r in split_pages(documents, page_mark="\f").collect()}
    assert by_mark == {(1, 0): text, (2, 0): "a", (2, 1): "b"}


def test_longest_document_breaks_ties_by_id(spark):
    documents = spark.createDataFrame([(3, "abc"), (2, "xyz"), (1, "a")], "doc_id long, full_text string")
    longest = longest_document(documents)
    assert longest.first()["doc_id"] == 2
    assert "TakeOrderedAndProject" in longest._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [0, 60, 1 << 18])
def test_words_of_small_documents_move_once(spark, monkeypatch, limit):
    monkeypatch.setattr(chunking, "WHOLE_TOKENS", limit)
    blocks = [(doc, at, " ".join(f"{doc}.{at}.{i}" for i in range(9))) for doc in range(12) for at in range(doc + 1)]
    texts = {doc: " ".join(text for other, _, text in blocks if other == doc) for doc in range(12)}
    frame = spark.createDataFrame([*blocks, (None, 0, "lost"), (20, 0, " ")], "doc_id long, at int, text string")
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, full_text string")
    settings = ChunkSettings(8, 3)
    whole = chunk_documents(documents, settings=settings)
    cut = chunk_blocks(frame, ["at"], settings=settings)
    assert sorted(cut.collect()) == sorted(whole.select(*cut.columns).collect())
    pieces = []
    monkeypatch.setattr(chunking, "_chunks_of_pieces", lambda rows, *rest: pieces.append(rows) or _chunks_of_pieces(rows, *rest))
    chunk_blocks(frame, ["at"], settings=settings)
    assert {row["doc_id"] for row in pieces[0].collect()} == {doc for doc in range(12) if 9 * (doc + 1) > limit}
