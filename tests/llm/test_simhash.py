import random
from itertools import combinations

import pyarrow as pa
import pytest
import xxhash

from folioseek.llm import simhash
from folioseek.llm.common import table
from folioseek.llm.queries import QUERIES
from conftest import SF_DIR


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)] if words else []
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute(rows):
    """Fingerprint and component of each row by comparing all rows."""
    prints = [brute_print(text) for _, text in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        same = rows[i][0] is not None and rows[i][0] == rows[j][0]
        if same or (prints[i] ^ prints[j]).bit_count() <= 2:
            part[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, f"{p:016x}", least.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def found(spark, rows, small=simhash.SMALL):
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, print int, least string, component long")
    result = simhash.near_duplicates(frame, small).select("doc_id", "fingerprint", "component_id")
    return sorted((tuple(r) for r in result.collect()), key=str)


def edge_rows():
    base = [f"w{i}" for i in range(150)]
    return [
        (5, " ".join(base)), (3, " ".join(base[:80] + ["new"] + base[81:])), (7, " ".join(base).upper()), (7, " ".join(base).upper()),
        (8, " ".join(base)), (8, "another text altogether"), (2, "another text altogether"), (1, None), (4, ""), (6, " \n\t "), (9, "one"),
        (10, "ONE"), (11, "one two"), (12, "one\x0btwo\r\n"), (13, "É one"), (14, "é one"), (None, " ".join(base)), (None, "alone here"),
        (None, None), (15, " ".join(f"v{i}" for i in range(70000))), (16, "a\x1cb c d e f"), (17, "a a a a a"), (-3, "one two three"),
    ]


@pytest.mark.parametrize("small", [1, 32])
def test_edge_cases_equal_brute_force(spark, small):
    assert found(spark, edge_rows(), small) == brute(edge_rows())


@pytest.mark.parametrize("small", [4])
def test_near_copies_equal_brute_force(spark, small):
    draw = random.Random(5)
    rows = []
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(60 + 300 * group)]
        for i in range(40):
            words = list(base)
            for place in draw.sample(range(len(base)), draw.choice([0, 1, 1, 2, 4])):
                words[place] = f"x{draw.randrange(9)}"
            rows.append((100 * group + i, " ".join(words)))
    expected = brute(rows)
    assert found(spark, rows, small) == expected
    assert 4 < len({component for _, _, component in expected}) < len(rows)


def test_query_equals_brute_force_on_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF_DIR, "documents").select("doc_id", "text").collect()]
    frame = QUERIES["op11_simhash_near_dedup"](spark, SF_DIR)
    assert sorted((tuple(r) for r in frame.select("doc_id", "fingerprint", "component_id").collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_other_id_types(spark):
    frame = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), (None, "x")], "doc_id string, text string")
    assert sorted(tuple(r)[2] or "" for r in simhash.near_duplicates(frame).collect()) == ["", "a", "a"]


def test_every_pair_within_the_radius_shares_a_table():
    tables = simhash.masks()
    assert len(tables) == 7 and all(30 <= mask.bit_count() <= 40 for mask in tables)
    for size in (0, 1, 2):
        for bits in combinations(range(64), size):
            flipped = sum(1 << bit for bit in bits)
            assert any(flipped & mask == 0 for mask in tables)


@pytest.mark.parametrize("small", [0, 1000])
def test_links_join_exactly_the_prints_in_reach(spark, small):
    draw = random.Random(8)
    centre = draw.getrandbits(64)
    prints = {centre}
    while len(prints) < 300:
        prints.add(draw.choice(sorted(prints)) ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
    prints |= {draw.getrandbits(64) for _ in range(50)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = [tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), small).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 and a < b for a, b in links)
    part = {p: p for p in signed}

    def root(p):
        while part[p] != p:
            p = part[p]
        return p

    for a, b in links:
        part[root(a)] = root(b)
    for a, b in combinations(signed, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
            assert root(a) == root(b)


def test_bounds_of_shingles():
    words, starts, ends, bounds = simhash.shingle_bounds(pa.array(["A b  c\td", "", None, " x y", "z"]))
    shingles = [words[a:b] for a, b in zip(starts, ends, strict=True)]
    assert shingles == [b"a b c", b"b c d", b"x y", b"z"] and bounds.tolist() == [0, 2, 2, 2, 3, 4]
