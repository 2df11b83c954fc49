import random

import pytest

from folioseek.llm import mixing

SCHEMA = "doc_id long, text string, source string, level int, size string, of string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "o") for r in rows], SCHEMA)


def brute_targets(sizes, percent=150):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_ = sum(sizes.values()) * percent / 100, set(order)
    target = {}
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if share * weights[s] > 2 * sizes[s]}
        if not full:
            return target | {s: share * weights[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def corpus():
    draw = random.Random(4)
    names = ["a", "b", "B", "é", None, "z", ""]
    rows = [(i, " ".join(f"w{draw.randrange(99)}" for _ in range(draw.choice([0, 1, 5, 40, 200]))), draw.choice(names)) for i in range(900)]
    return [*rows, (900, None, "a"), (901, "", None), (902, "x y", "single"), (None, "n n n", "a"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]


def test_targets_and_words_taken(spark):
    rows = corpus()
    mixed = mixing.mixed(documents(spark, rows)).collect()
    assert len(mixed) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    goal = brute_targets(sizes)
    taken = {}
    for row in mixed:
        assert row.source_size == sizes[row.source] and row.target == pytest.approx(goal[row.source])
        assert row.taken == row.copies * row.size and row.copies in (0, 1, 2) and (row.size or not row.copies)
        taken[row.source] = taken.get(row.source, 0) + row.taken
    for source, size in sizes.items():
        assert abs(taken[source] - goal[source]) <= 200, (source, size)


def test_reruns_and_partitions_agree(spark):
    rows = corpus()
    first = mixing.mixed(documents(spark, rows)).select("doc_id", "copies", "size")
    second = mixing.mixed(documents(spark, rows[::-1]).repartition(7)).select("doc_id", "copies", "size")
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))


def test_ranks_are_pareto(spark):
    """The chosen are those of smallest rank: no document left out ranks before one taken."""
    rows = [(i, " ".join(f"w{k % (1 + i % 9)}" for k in range(20)), "ab"[i % 3 == 0]) for i in range(400)]
    sizes = mixing.sized(documents(spark, rows), mixing.distinct_share).cache()
    plan = mixing.plan(sizes)
    joined = sizes.drop("text", "of").join(plan, (sizes.source == plan.of) & (sizes["weight level"] == plan.at)).withColumn("rank", mixing._rank(1, plan.part)).where("rank is not null")
    ranks = {r.doc_id: (r.source, r.rank, r.whole) for r in joined.collect()}
    chosen = {r.doc_id: r.copies for r in mixing.taken(sizes, plan).collect()}
    for source in "ab":
        own = sorted((rank, chosen[i] - whole) for i, (s, rank, whole) in ranks.items() if s == source)
        extra = [e for _, e in own]
        assert extra == sorted(extra, reverse=True) and set(extra) <= {0, 1}


def test_empty_table_and_only_empty_texts(spark):
    assert mixing.mixed(documents(spark, [])).count() == 0
    rows = mixing.mixed(documents(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.taken) for r in rows] == [(0, 0), (0, 0)]


@pytest.mark.parametrize("ids", ["null", "repeated", "two of them"])
def test_equal_rows_are_taken_one_by_one(spark, ids):
    """Thousands of rows that are equal in all that a rank knows; texts differ in their words only."""
    doc_id = {"null": lambda i: None, "repeated": lambda i: 7, "two of them": lambda i: i % 2}[ids]
    rows = [(doc_id(i), " ".join(f"w{k}" for k in range(100)), "abc"[i % 3]) for i in range(3000)]
    first = mixing.mixed(documents(spark, rows)).collect()
    assert len(first) == len(rows)
    for source in "abc":
        own = [r for r in first if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 50
        assert max(r.copies for r in own) - min(r.copies for r in own) <= 1
    again = mixing.mixed(documents(spark, rows[::-1]).repartition(5)).collect()
    count = lambda found: sorted(map(str, ((r.doc_id, r.source, r.copies) for r in found)))
    assert count(first) == count(again)
