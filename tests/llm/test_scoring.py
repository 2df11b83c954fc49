import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from folioseek.llm import queries, scoring
from folioseek.llm.elias_fano import Monotone
from folioseek.llm.trie import Level


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=300), st.lists(st.integers(0, 2**62), max_size=30), st.integers(0, 61))
def test_sequences_find_what_they_hold(values, others, shift):
    values = np.array(sorted({v >> shift for v in values}), dtype=np.int64)
    others = np.array([v >> shift for v in others], dtype=np.int64)
    coded = Monotone.of(values)
    assert (coded.at(np.arange(len(values))) == values).all() and (coded.find(values) == np.arange(len(values))).all()
    places = {int(v): i for i, v in enumerate(values)}
    assert coded.find(others).tolist() == [places.get(int(v), -1) for v in others]


def test_repeated_values_have_their_first_place():
    coded = Monotone.of(np.array([0, 0, 3, 3, 3, 9]))
    assert coded.at(np.arange(6)).tolist() == [0, 0, 3, 3, 3, 9] and coded.find(np.array([0, 3, 9, 4, 10])).tolist() == [0, 2, 5, -1, -1]


@pytest.mark.parametrize("share", [0.002, 0.1, 0.5, 0.9, 0.998])
def test_selects_over_many_blocks(share):
    marks = np.random.default_rng(3).random(20000) < share
    high = np.cumsum(~marks)[marks]
    coded = Monotone.of(high << 7)
    bits = np.unpackbits(coded.bits.view(np.uint8), bitorder="little")
    # The bits are those of some width; both kinds of places are compared with a plain reading of them.
    for ones in (True, False):
        places = np.flatnonzero(bits == ones)
        assert (coded._select(np.arange(len(places)), ones) == places).all()


def test_an_ngram_that_repeats_is_looked_up_once(spark, monkeypatch):
    text = " ".join(["a b c d"] * 200)
    model = scoring.trained(spark.createDataFrame([(text,)], "text string"), min_count=1)
    asked, find = [], Monotone.find
    monkeypatch.setattr(Monotone, "find", lambda self, values: (asked.append(len(values)), find(self, values))[1])
    read = model.read(pa.array([text, text]))
    # Words, then bigrams and trigrams: a begin, four in the text, and an end.
    assert all(n <= 7 for n in asked) and len(read.word) == 2 * 802
    assert (read.entries[2][3:801] >= 0).all()


def test_an_ngram_that_repeats_is_scored_once(spark, monkeypatch):
    text = " ".join(["a b c d"] * 200)
    model = scoring.trained(spark.createDataFrame([(text,)], "text string"), min_count=1)
    asked, values = [], Level._values
    monkeypatch.setattr(Level, "_values", lambda self, entries, name: (asked.append(len(entries)), values(self, entries, name))[1])
    read = model.read(pa.array([text, text, "x a"]))
    chances = scoring.probabilities(model, read)
    assert asked and all(n <= 7 for n in asked)
    assert (chances[1:802] == chances[803:1604]).all() and (read.entries[1][-3:] == [-1, -1, -1]).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), min_size=2, max_size=300), st.integers(0, 39))
def test_spans_are_values_and_those_after_them(values, shift):
    values = np.sort(np.array(values, dtype=np.int64) >> shift)
    begin, end = Monotone.of(values).spans(np.arange(len(values) - 1))
    assert (begin == values[:-1]).all() and (end == values[1:]).all()


def test_spans_over_a_long_gap():
    values = np.array([0, 1, 2, 3, 4, 5, 6, 7 << 20, 8 << 20])
    begin, end = Monotone.of(np.repeat(values, 40)).spans(np.arange(40 * len(values) - 1))
    assert (begin == np.repeat(values, 40)[:-1]).all() and (end == np.repeat(values, 40)[1:]).all()


@pytest.mark.parametrize("even", [True, False])
def test_a_long_run_is_searched_in_few_steps(monkeypatch, even):
    draw = np.random.default_rng(8)
    values = np.unique(draw.integers(0, 1 << 27, 4000) if even else np.exp2(draw.random(4000) * 27).astype(np.int64))
    # One value far off makes the others a single run.
    coded = Monotone.of(np.append(values, 1 << 40))
    coded.distinct = True
    others = np.setdiff1d(draw.integers(0, 1 << 27, 4000), values)
    asked, low = [], Monotone._low
    monkeypatch.setattr(Monotone, "_low", lambda self, i: (asked.append(len(i)), low(self, i))[1])
    assert (coded.find(values) == np.arange(len(values))).all()
    assert len(asked) <= 11 and (not even or sum(asked) < 7 * len(values))
    assert (coded.find(others) == -1).all() and len(asked) <= 22


def test_an_ngram_is_found_without_the_begin_and_end_of_its_context(spark, monkeypatch):
    frame = spark.createDataFrame([("a b c a b d",), ("b c",)], "text string")
    model = scoring.trained(frame, min_count=1)
    selects, select = [], Monotone._select
    monkeypatch.setattr(Monotone, "_select", lambda self, k, ones: (selects.append(ones), select(self, k, ones))[1])
    read = model.read(pa.array(["a b c a b d", "b c", "c b"]))
    assert (read.entries[2][2:8] >= 0).all() and read.entries[1][-2] == -1
    # A search for each of three levels, and none for a context.
    assert len(selects) <= 3 and not any(selects)


@pytest.mark.parametrize("end", [1 << 20, 1 << 62])
def test_numbers_are_ordered_with_their_places(end):
    numbers = np.random.default_rng(5).integers(0, end, 500)
    found, order = scoring._ordered(numbers, end)
    assert (found == np.sort(numbers)).all() and (numbers[order] == found).all() and sorted(order) == list(range(500))


def test_blocks_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**62, 1000))
    counts = np.random.default_rng(2).integers(1, 2**40, len(keys))
    got = scoring.unpacked(scoring.packed(keys, counts))
    assert (got[0] == keys).all() and (got[1] == counts).all()


def tokens(text):
    """The begin, the words and the end of a text; no word holds a space."""
    return ["<s >", *(w.decode() for w in (text or "").encode().lower().split()), "</s >"]


def brute(training, texts, min_count):
    """Scores by dictionaries, after the formulas of the module."""
    split = [tokens(t) for t in training]
    one = Counter(w for t in split for w in t[1:])
    two = Counter(p for t in split for p in zip(t, t[1:], strict=False))
    three = Counter(p for t in split for p in zip(t, t[1:], t[2:], strict=False))
    two, three = ({k: v for k, v in c.items() if v >= min_count} for c in (two, three))
    total, kept = sum(one.values()), Counter()
    count = lambda c: len(split) if c == ("<s >",) else one[c[0]] if len(c) == 1 else two[c]
    for counts in (two, three):
        for gram, n in counts.items():
            kept[gram[:-1]] += (n - 0.5) / count(gram[:-1])
    for text in texts:
        words = tokens(text)
        base = score = 0.0
        for i in range(1, len(words)):
            p = (one[words[i]] + 1) / (total + len(one) + 1)
            base += math.log10(p)
            for n, counts in ((1, two), (2, three)):
                context = tuple(words[i - n : i]) if i >= n else None
                if context and (n == 1 or context in two):
                    gram = (*context, words[i])
                    p = ((counts[gram] - 0.5) / count(context) if gram in counts else 0) + (1 - kept[context]) * p
            score += math.log10(p)
        yield len(words) - 1, sum(w in one for w in words[1:]), total, base, score


@pytest.mark.parametrize(("part", "min_count"), [(scoring.PART_TOKENS, 1), (300, 1), (300, 2)])
def test_scores_equal_brute_force(spark, monkeypatch, part, min_count):
    monkeypatch.setattr(scoring, "PART_TOKENS", part)
    draw = random.Random(6)
    texts = [" ".join(f"W{int(draw.expovariate(0.08))}" for _ in range(draw.choice([0, 1, 30, 90]))) for _ in range(60)]
    texts += [None, "", "same text twice", "same text twice", "</s> <s>", "é\x00 É " * 50, "w1 " * 2000]
    rows = [(i, t, i % 5 != 0, 7) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, train boolean, count int")
    model = scoring.trained(frame.where("train"), min_count=min_count)
    got = {r.doc_id: r for r in scoring.scored(frame.select("doc_id", "text"), model).collect()}
    expected = brute([t for _, t, train, _ in rows if train], texts, min_count)
    for i, (n, known, total, base, score) in enumerate(expected):
        row = got[i]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (n, known, total)
        assert row.base_score == pytest.approx(base, rel=1e-12)
        assert row.score == pytest.approx(score, abs=0.0004 * n + 1e-9)
    if part == 300:
        assert len(model.levels[0].rows) > 2 and len(model.levels[1].rows) > 2


def test_probabilities_do_not_exceed_one(spark):
    texts = ["a b c", "a b d", "a c", "b c b c", "a b c"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    model = scoring.trained(frame)
    import pyarrow as pa

    for prefix in ("", "a", "a b", "b c", "x", "c b"):
        chances = []
        for word in ["a", "b", "c", "d", "unknown"]:
            read = model.read(pa.array([f"{prefix} {word}"]))
            chances.append(scoring.probabilities(model, read)[-2])
        read = model.read(pa.array([prefix]))
        chances.append(scoring.probabilities(model, read)[-1])
        assert 0.98 < sum(chances) <= 1 + 1e-9


def test_empty_training(spark):
    none = spark.createDataFrame([], "text string")
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = scoring.scored(frame, scoring.trained(none)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]


def test_query_keeps_ngrams_seen_once(spark, tmp_path):
    texts = {i: f"a{i} b{i} c{i}" for i in range(40)}
    held_out = [i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2]
    known = next(i for i in texts if i not in held_out)
    texts |= {held_out[0]: texts[known], held_out[1]: f"c{known} a{known} b{known + 1}"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op7_trie_scores(spark, str(tmp_path)).collect()}
    assert rows[held_out[0]].n_known == 4 and rows[held_out[0]].score > rows[held_out[0]].base_score + 2
