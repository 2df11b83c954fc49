import random
import zlib
from hashlib import sha256

import pytest

from folioseek.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_rebuilt(rows):
    by_conv = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        by_conv.setdefault(conv, []).append((role or "", text or ""))
    done = {}
    for conv, own in by_conv.items():
        head = zlib.crc32(str(conv).encode()) % 6
        first = conv - (abs(conv) % 100) * (1 if conv >= 0 else -1)
        done[conv] = by_conv.get(first, [])[:head] + own[head:]
    return done


def brute(convs):
    """Every node with its members, subtree by subtree."""
    members = {}
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    result = []
    for node, own in members.items():
        below = [other for other in members if other[: len(node)] == node]
        children = [other for other in below if len(other) == len(node) + 1]
        leaves = [other for other in below if not any(len(x) == len(other) + 1 and x[: len(other)] == other for x in below)]
        saved = sum((len(members[other]) - 1) * len(other[-1][1]) for other in below if other)
        ends = sorted(conv for conv in own if len(convs[conv]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = sha256(",".join(map(str, ends)).encode()).hexdigest()
        result.append((min(own), len(node), parent, len(own), len(children), len(leaves), saved, digest))
    return sorted(result, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, k1 string").repartition(3)


def edge_rows():
    rows = [(c, t, "user", f"turn {t}") for c in (0, 1, 2, 50, 99, 150, 199) for t in range(9)]
    rows += [(3, 0, None, None), (3, None, "user", "early"), (4, 1, "a", "same"), (4, 1, "a", "same"), (4, 1, "A", "é😀"), (None, 0, "user", "lost")]
    rows += [(-5, 0, "user", "turn 0"), (-5, 1, "user", "turn 1"), (200, 0, "user", "only"), (201, 0, "user", "short"), (300, 0, "", ""), (301, 0, "", "")]
    rows += [(c, t, "user", f"turn {t}" if t < 7 else f"own {c % 3}") for c in range(400, 440) for t in range(c % 12)]
    return rows + [(7, t, "user", f"long {t}") for t in range(600)]


def test_rebuilt_conversations_equal_brute_force(spark):
    conversations, turns = prefix_trie.rebuilt(prefix_trie.numbered(table_of(spark, edge_rows())).cache())
    expected = brute_rebuilt(edge_rows())
    got = {r["conv_id"]: [] for r in conversations.collect()}
    for r in sorted(turns.collect(), key=lambda r: r["d"]):
        got[r["conv_id"]].append((r["role"], r["text"]))
        assert len(got[r["conv_id"]]) == r["d"]
    assert got == expected
    short = {conv: turns[:20] for conv, turns in expected.items()}
    frame = spark.createDataFrame([(c, d, r, t) for c, turns in short.items() for d, (r, t) in enumerate(turns, 1)], "conv_id long, d long, role string, text string")
    assert found(prefix_trie.prefix_trie(spark.createDataFrame([(c,) for c in short], "conv_id long"), frame)) == brute(short)


@pytest.mark.parametrize(("block", "piece"), [(1, 2), (3, 1 << 14)])
def test_random_conversations_equal_brute_force(spark, monkeypatch, block, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    draw = random.Random(block)
    convs = {c: [(draw.choice("ab"), draw.choice(["x", "yy"])) for _ in range(draw.randrange(7))] for c in range(-40, 80)}
    for c in range(80, 110):
        convs[c] = convs[draw.randrange(-40, 80)] + [("a", "zzz")] * draw.choice([0, 8, 8, 9])
    frame = spark.createDataFrame([(c, d, r, t) for c, turns in convs.items() for d, (r, t) in enumerate(turns, 1)], "conv_id long, d long, role string, text string")
    assert found(prefix_trie.prefix_trie(spark.createDataFrame([(c,) for c in convs], "conv_id long"), frame, block)) == brute(convs)


def test_empty_tables_and_turnless_conversations(spark):
    conversations, turns = prefix_trie.rebuilt(prefix_trie.numbered(table_of(spark, [])))
    assert found(prefix_trie.prefix_trie(conversations, turns)) == []
    three = spark.createDataFrame([(5,), (12,), (-1,)], "conv_id long")
    assert found(prefix_trie.prefix_trie(three, turns)) == brute({5: [], 12: [], -1: []})
