import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioseek.config import ChunkSettings
from folioseek.operators import embedders, retrieval
from folioseek.operators.chunking import chunk_with_tokenizer
from folioseek.operators.embedders import HashedTerms, SparseScorer, UserVectors, term_runs
from folioseek.operators.index import build_index, index_chunks, open_index
from folioseek.operators.retrieval import BestRows, nearest
from folioseek.sources.scratch import fresh_path

SETTINGS = ChunkSettings(12, 3)
WORDS = [f"word{i}" for i in range(60)]


def texts(seed, n, longest=40):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [" ".join(rng.choices(WORDS, weights, k=rng.randint(1, longest))) for _ in range(n)]


def bucket(word, dim):
    return zlib.crc32(word.encode()) % dim


def brute_force(corpus, questions, k, dim):
    """Ranked ``(doc_id, chunk_no)`` and scores per question, in plain Python."""
    chunks = {}
    for doc_id, text in corpus:
        words = text.split()
        for number, start in enumerate(range(0, len(words), SETTINGS.step)):
            part = words[start : start + SETTINGS.size]
            chunks[doc_id, number] = Counter(bucket(word, dim) for word in part)
    df = Counter(b for vector in chunks.values() for b in vector)
    weight = lambda b: (len(chunks) // max(df[b], 1)).bit_length()
    norm = lambda v: sum((tf * weight(b)) ** 2 for b, tf in v.items())
    result = {}
    for question_id, text in questions:
        asked = Counter(bucket(word, dim) for word in text.split())
        scored = []
        for key, vector in chunks.items():
            dot = sum(tf * vector[b] * weight(b) ** 2 for b, tf in asked.items())
            if dot:
                scored.append((-dot / math.sqrt(norm(asked) * norm(vector)), key))
        result[question_id] = [(key, round(-score, 9)) for score, key in sorted(scored)[:k]]
    return result


@pytest.fixture(scope="module")
def data():
    corpus = list(enumerate(texts(1, 60)))
    # A third of all documents are copies of one text.
    corpus += [(100 + i, corpus[0][1]) for i in range(30)]
    questions = list(enumerate(texts(2, 9, 6))) + [(50, "nowhere to be found"), (51, "")]
    return corpus, questions


@pytest.fixture(scope="module")
def index(spark, data):
    corpus = spark.createDataFrame([(i, f"s{i % 4}", t) for i, t in data[0]], "doc_id long, source string, full_text string")
    return build_index(corpus, fresh_path(spark, "index"), SETTINGS, HashedTerms(dim=512))


def question_frame(spark, data):
    return spark.createDataFrame(data[1], "question_id long, question string")


def ranked(rows):
    found = {}
    for row in sorted(rows, key=lambda r: (r["question_id"], r["rank"])):
        found.setdefault(row["question_id"], []).append(((row["doc_id"], row["chunk_no"]), round(row["score"], 9)))
    return found


def test_matches_brute_force(spark, data, index):
    found = ranked(index.retrieve(question_frame(spark, data), k=5, prefix="").collect())
    expected = {q: hits for q, hits in brute_force(*data, 5, 512).items() if hits}
    assert found == expected


def test_chunks_of_a_user_tokenizer_can_be_indexed(spark, data, index):
    corpus = spark.createDataFrame([(i, f"s{i % 4}", t) for i, t in data[0]], "doc_id long, source string, full_text string")
    chunks = chunk_with_tokenizer(corpus, str.split, " ".join, settings=SETTINGS)
    other = index_chunks(chunks, fresh_path(spark, "index"), HashedTerms(dim=512))
    questions = question_frame(spark, data)
    columns = ["question_id", "rank", "doc_id", "chunk_no", "source", "text"]
    assert sorted(other.retrieve_texts(questions, 5).select(*columns).collect()) == sorted(
        index.retrieve_texts(questions, 5).select(*columns).collect()
    )


def test_many_questions_go_in_bounded_blocks(spark, data, index, monkeypatch):
    questions = question_frame(spark, data)
    whole = sorted(index.retrieve_texts(questions, k=5).collect())
    monkeypatch.setattr(retrieval, "MAX_BLOCK_HITS", 10)
    assert retrieval._block_count(index.embedder.vectorize(questions, "question"), F.lit(1), 5) > 1
    assert sorted(index.retrieve_texts(questions, k=5).collect()) == whole


def test_repeated_question_ids_are_refused(spark, index, monkeypatch):
    monkeypatch.setattr(retrieval, "MAX_BLOCK_HITS", 1)
    questions = spark.createDataFrame([(7, "word1"), (7, "word2")], "question_id long, question string")
    with pytest.raises(ValueError, match="unique"):
        index.retrieve(questions, k=5)


def test_hit_texts_are_read_from_their_parts_only(spark, data, index):
    hits = index.retrieve_texts(question_frame(spark, data), k=2)
    rows = hits.collect()
    by_id = dict(data[0])
    for row in rows:
        words = by_id[row["doc_id"]].split()
        start = row["chunk_no"] * SETTINGS.step
        assert row["text"] == " ".join(words[start : start + SETTINGS.size])
        assert row["source"] == f"s{row['doc_id'] % 4}"
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row," in plan


def test_index_can_be_opened_with_its_embedder_only(spark, index):
    assert open_index(spark, index.path, HashedTerms(dim=512)).meta["num_chunks"] == index.chunks.count()
    with pytest.raises(ValueError):
        open_index(spark, index.path, HashedTerms(dim=1024))
    with pytest.raises(ValueError):
        open_index(spark, index.path, UserVectors("other", 512))


def test_empty_corpus(spark):
    corpus = spark.createDataFrame([], "doc_id long, source string, full_text string")
    empty = build_index(corpus, fresh_path(spark, "index"))
    questions = spark.createDataFrame([(1, "a")], "question_id long, question string")
    assert empty.retrieve_texts(questions).count() == 0


def test_no_questions(spark, index):
    assert index.retrieve_texts(spark.createDataFrame([], "question_id long, question string")).count() == 0


def test_text_ids(spark):
    corpus = spark.createDataFrame(
        [("b/2", "s", "x y"), ("a/1", "s", "x y"), ("c", "s", "z z")], "doc_id string, source string, full_text string"
    )
    questions = spark.createDataFrame([("q1", "x"), ("q2", "z")], "question_id string, question string")
    index = build_index(corpus, fresh_path(spark, "index"))
    rows = index.retrieve(questions, k=2, prefix="").collect()
    assert sorted((r["question_id"], r["rank"], r["doc_id"]) for r in rows) == [
        ("q1", 1, "a/1"),
        ("q1", 2, "b/2"),
        ("q2", 1, "c"),
    ]


def letters(batch):
    return [[text.count("a"), text.count("b"), len(text)] for text in batch]


def test_user_embedder(spark):
    corpus = spark.createDataFrame(
        [(i, "s", t) for i, t in enumerate(["aaa", "bbb", "ab", "aab"])], "doc_id long, source string, full_text string"
    )
    questions = spark.createDataFrame([(1, "aaa"), (2, "ba")], "question_id long, question string")
    embedder = UserVectors("letters", 3, letters)
    index = build_index(corpus, fresh_path(spark, "index"), embedder=embedder)
    rows = index.retrieve_texts(questions, k=2, prefix="").collect()
    assert sorted((r["question_id"], r["rank"], r["text"], r["score"]) for r in rows) == [
        (1, 1, "aaa", 0.0),
        (1, 2, "aab", -2.0),
        (2, 1, "ab", 0.0),
        (2, 2, "aab", -2.0),
    ]


def test_dense_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    stored = rng.normal(size=(80, 6)).astype(np.float32)
    stored[40:] = stored[0]  # half of all rows are copies
    asked = rng.normal(size=(5, 6)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(stored)], "vec_id long, vec array<float>")
    questions = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "question_id int, vec array<float>")
    rows = nearest(questions, vectors.repartition(7), UserVectors("given", 6), ["vec_id"], 8).collect()
    for q, vector in enumerate(asked):
        distance = ((stored.astype(float) - vector.astype(float)) ** 2).sum(axis=1)
        expected = sorted((round(d, 6), i) for i, d in enumerate(distance))[:8]
        found = sorted((r["rank"], r["vec_id"]) for r in rows if r["question_id"] == q)
        assert [i for _, i in found] == [i for _, i in expected]


def test_vectors_of_another_length_are_refused(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, vec array<float>")
    questions = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "question_id int, vec array<float>")
    with pytest.raises(Exception, match="does not have 3 numbers"):
        nearest(questions, vectors, UserVectors("given", 3), ["vec_id"], 1).collect()


@pytest.mark.parametrize("tile", [1, 7, 100, 10**6])
def test_scores_do_not_depend_on_tiles(monkeypatch, tile):
    rng = np.random.default_rng(tile)
    chunks = [np.sort(rng.integers(0, 20, size=rng.integers(0, 30))) for _ in range(25)]
    questions = [np.sort(rng.integers(0, 20, size=rng.integers(0, 8))) for _ in range(6)]
    weights = rng.integers(1, 5, size=20)
    dense = lambda rows: np.array([np.bincount(r, minlength=20) for r in rows]) * weights
    c, q = dense(chunks), dense(questions)
    lengths = np.sqrt((c**2).sum(1)[:, None] * (q**2).sum(1)[None, :])
    expected = np.divide(c @ q.T, lengths, out=np.zeros((25, 6)), where=lengths > 0)
    monkeypatch.setattr(embedders, "TILE_CELLS", tile)
    scorer = SparseScorer(questions, weights**2)
    array = pa.array([r.tolist() for r in chunks], pa.list_(pa.int32()))
    scores = np.vstack([scores for _, scores in scorer.tiles(array)])
    np.testing.assert_allclose(scores, expected, atol=1e-12)
    sliced = np.vstack([scores for _, scores in scorer.tiles(array.slice(4, 9))])
    np.testing.assert_allclose(sliced, expected[4:13], atol=1e-12)


def test_term_runs_keep_rows_apart():
    row, bucket_, tf = term_runs(np.array([3, 3, 3, 5]), np.array([2, 0, 2]))
    assert (row.tolist(), bucket_.tolist(), tf.tolist()) == ([0, 2, 2], [3, 3, 5], [2, 1, 1])


@pytest.mark.parametrize("seed", range(5))
def test_best_rows_over_tiles(seed):
    rng = np.random.default_rng(seed)
    scores = rng.integers(0, 5, size=(200, 4)).astype(float)
    ids = rng.permutation(200)
    best = BestRows(4, 6, 0.0)
    for top in range(0, 200, 17):
        best.add(scores[top : top + 17], [ids[top : top + 17]])
    for q in range(4):
        expected = sorted((-s, i) for s, i in zip(scores[:, q], ids) if s > 0)[:6]
        at = best.question == q
        assert sorted(zip(-best.score[at], best.ids[0][at])) == expected
