import random

import pyarrow as pa
import pytest

from folioseek.llm import decontamination as dc
from folioseek.llm.common import tokens


def words(draw, count, size=400):
    return " ".join(f"w{draw.randrange(size) if draw.random() < 0.7 else draw.randrange(8)}" for _ in range(count))


@pytest.fixture(scope="module")
def items():
    draw = random.Random(1)
    rows = [(i, words(draw, draw.choice([6, 20, 40, 90])), words(draw, draw.choice([0, 5, 12]))) for i in range(60)]
    return [*rows, (60, "", ""), (61, rows[3][1], rows[3][2]), (3, rows[4][1], rows[4][2])]


def text_ids(index, texts):
    found = tokens(pa.array(texts, pa.string()), dc.WORD)
    return index.ids(found)[found.codes], found.starts


@pytest.mark.parametrize("cells", [dc.CELLS, 64])
def test_search_finds_every_segment_above_the_threshold(items, monkeypatch, cells):
    monkeypatch.setattr(dc, "CELLS", cells)
    draw = random.Random(2)
    index = dc.ItemIndex(items)
    texts = [words(draw, draw.choice([0, 3, 31, 64, 65, 300])) for _ in range(40)]
    texts += [words(draw, 50) + " " + f"{q} {a}" + " " + words(draw, 45) for _, q, a in items[::4]] + [None]
    ids, starts = text_ids(index, texts)
    found = {
        (int(text), int(begin), int(segment), round(float(score), 9))
        for arrays in index.above(ids, starts)
        for text, begin, segment, score in zip(*arrays, strict=True)
    }
    expected = set()
    for text in range(len(texts)):
        for begin in range(starts[text], starts[text + 1], dc.STRIDE):
            passage = set(ids[begin : min(begin + 2 * dc.STRIDE, starts[text + 1])].tolist())
            for number, (own, weights) in enumerate(index.segments):
                score = sum(w for t, w in zip(own.tolist(), weights.tolist(), strict=True) if t in passage)
                if score >= dc.MIN_SCORE:
                    expected.add((text, int(begin), number, round(float(score), 9)))
    found, expected = ({row[:3]: row[3] for row in rows} for rows in (found, expected))
    assert found.keys() == expected.keys() and len(expected) > 20
    assert all(abs(found[row] - score) < 1e-8 for row, score in expected.items())


def test_leaks_and_clean_texts(spark, items):
    draw = random.Random(3)
    whole = {i: f"{q}. {a}" for i, q, a in items[:60]}
    texts = {i: words(draw, 200) + " " + text.upper() + " " + words(draw, 70) for i, text in whole.items()}
    texts |= {100 + i: words(draw, 150) for i in range(40)} | {200: None, 201: ""}
    halves = {300 + i: words(draw, 90) + " " + " ".join(text.split()[: len(text.split()) // 2]) for i, text in whole.items() if len(text.split()) > 30}
    frame = spark.createDataFrame([(i, t, 1) for i, t in (texts | halves).items()], "doc_id long, text string, leaks int")
    bench = spark.createDataFrame(items, "item_id long, question string, answer string")
    for size in (dc.MAX_BLOCK_WORDS, 100):
        rows = {r.doc_id: {leak.item_id for leak in r.leaks} for r in dc.searched(frame, bench, keep=["doc_id"], max_words=size).collect()}
        assert all(i in rows[i] for i in whole)
        assert {61} <= rows[3] and all(not rows[i] for i in rows if i >= 100)


def test_items_are_split_before_the_last_sentence(spark):
    rows = [(1, "What is it? It is this."), (2, "one sentence only."), (3, None), (4, "a\nb c"), (5, "A. B! C d e")]
    frame = dc.parted(spark.createDataFrame(rows, "item_id long, text string"))
    assert [(r.question, r.answer) for r in frame.orderBy("item_id").collect()] == [
        ("What is it?", "It is this."), ("one sentence only.", ""), ("", ""), ("a\nb c", ""), ("A. B!", "C d e"),
    ]


def test_empty_tables(spark, items):
    bench = spark.createDataFrame(items, "item_id long, question string, answer string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert dc.searched(none, bench).count() == 0
    some = spark.createDataFrame([(1, "x y z")], "doc_id long, text string")
    assert [r.leaks for r in dc.searched(some, bench.limit(0)).collect()] == [[]]


def test_short_parts_are_found_near_the_question():
    question = "which city on the river seine is the capital of france"
    rows = [(1, question, "Paris"), (2, "do magnets attract iron nails at room temperature", "yes they"), (3, "ping pong", ""), (4, "alpha", "omega")]
    index = dc.ItemIndex(rows)
    filler = " ".join(f"f{i}" for i in range(300))
    texts = [
        f"{filler} {question}? Answer: Paris {filler}", f"{question}? Answer: London. {filler} Paris", f"Paris: {question}", f"{question} Paris",
        f"{filler} {rows[1][1]}? A. yes, they do", f"{rows[1][1]}? they yes", "a ping pong b", "ping b pong", "alpha is not omega", "alpha", "",
    ]
    found = index.search(*text_ids(index, texts))
    expected = [{1}, set(), {1}, {1}, {2}, set(), {3}, set(), {4}, set(), set()]
    assert [{leak[0] for leak in found.get(i, [])} for i in range(len(texts))] == expected
