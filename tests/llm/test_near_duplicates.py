import math
import random

import numpy as np
import pyarrow as pa
import pytest

from folioseek.llm import near_duplicates as nd


def brute(rows, size, percent):
    """Component and set size of each row by comparing all sets."""
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        k = min(size, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    ids = sorted({i for i, _ in rows if i is not None})
    least = {i: i for i in ids}
    links = [
        (a, b)
        for (a, _), s in zip(rows, sets, strict=True)
        for (b, _), t in zip(rows, sets, strict=True)
        if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t)
    ]
    while True:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    return sorted(((i, len(s), least.get(i), i is None or least[i] == i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def found(spark, rows, size, percent):
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, band int, class string, component long")
    result = nd.near_duplicates(frame, size, percent).select("doc_id", "n_shingles", "component_id", "kept")
    return sorted((tuple(r) for r in result.collect()), key=str)


def edge_rows():
    base = [f"w{i}" for i in range(120)]
    near = base[:60] + ["other"] + base[61:]
    return [
        (5, " ".join(base)), (3, " ".join(near)), (9, " ".join(near[:100] + ["x", "y"] + near[100:])), (7, " ".join(base).upper()),
        (7, " ".join(base).upper()), (1, None), (2, ""), (4, " \n\t "), (6, "one"), (8, "one"), (10, "one two"), (11, "ONE\x0btwo"),
        (12, "É one"), (13, "é one"), (None, " ".join(base)), (14, " ".join(f"v{i}" for i in range(30000))), (15, "a\x1cb c d e f"),
    ]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_edge_cases_equal_brute_force(spark, size, percent):
    assert found(spark, edge_rows(), size, percent) == brute(edge_rows(), size, percent)


def test_crowded_group_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "PART", 8)
    draw = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        for place in draw.sample(range(150), draw.choice([0, 1, 2, 4, 6, 9])):
            words[place] = f"x{draw.randrange(1000)}"
        rows.append((i, " ".join(words)))
    assert found(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_repeated_ids_with_several_texts_equal_brute_force(spark):
    a, b = (" ".join(f"{side}{i}" for i in range(100)) for side in "ab")
    rows = [(1, a), (1, b), (2, f"{b} z"), (3, f"{a} z"), (4, "of its own"), (4, None), (5, f"{a} y"), (5, "another text altogether"), (6, "another text altogether")]
    assert found(spark, rows, 3, 85) == brute(rows, 3, 85)
    draw = random.Random(3)
    texts = [" ".join(draw.choice([a, b]).split()[:90] + [f"n{draw.randrange(3)}"]) for _ in range(40)]
    rows = [(draw.randrange(25), text) for text in texts]
    assert found(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_empty_table(spark):
    assert found(spark, [], 5, 80) == []


def test_signature_estimates_similarity():
    draw = np.random.default_rng(3)
    common, rest = draw.integers(1, 2**62, 800).astype(np.uint64), draw.integers(1, 2**62, 200).astype(np.uint64)
    a, b = (nd.signature(np.unique(s)) for s in (np.concatenate([common, rest[:100]]), np.concatenate([common, rest[100:]])))
    assert abs((a == b).mean() - 0.8**nd.ROWS) < 0.3


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_required_bands_lose_one_pair_in_a_million_at_most(percent):
    equal = (percent / 100) ** nd.ROWS
    bands = nd.shared_bands(percent)
    lost = [sum(math.comb(nd.BANDS, k) * equal**k * (1 - equal) ** (nd.BANDS - k) for k in range(n)) for n in (bands, bands + 1)]
    assert lost[0] <= 1e-6 < lost[1]


def test_shingles_do_not_cross_texts():
    sets = list(nd.shingle_sets(pa.array(["a b c d", "a b", "", None, "a b c d"]), 3))
    assert [len(s) for s in sets] == [2, 1, 0, 0, 2]
    assert (sets[0] == sets[4]).all() and not set(sets[0]) & set(sets[1])


def test_links_of_a_document_are_counted(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base), " ".join(base[:-1] + ["x"]), " ".join(base[:-1] + ["y"]), " ".join(base), "alone"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_links"] for r in nd.near_duplicates(frame, 3, 85).collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 0}


@pytest.mark.parametrize("members", [nd.MEMBERS, 1000, 50])
def test_runs_of_sets_lose_no_link(monkeypatch, members):
    monkeypatch.setattr(nd, "MEMBERS", members)
    draw = np.random.default_rng(3)
    bases = [np.sort(draw.choice(3000, int(draw.integers(40, 400)), replace=False)).astype(np.uint64) for _ in range(6)]
    sets = [bases[i % 6][draw.random(len(bases[i % 6])) > 0.06] for i in range(60)]
    pairs = [(i, j) for i in range(60) for j in range(i + 1, 60)]
    near = [(i, j) for i, j in pairs if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert near and sorted(nd._linked(sets, *map(np.array, zip(*pairs, strict=True)), 80)) == near
