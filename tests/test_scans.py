"""Running values over ranges of rows, against a plain loop."""

import random

import pytest

from folioseek.operators.scans import running
from pyspark.sql import functions as F


def brute(rows):
    state, found = {}, []
    for key, place, n, bits, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        total, mixed, last = state.get(key, (0, 0, None))
        state[key] = total + (n or 0), mixed ^ (bits or 0), last if text is None else text
        found.append((key, place, *state[key]))
    return found


@pytest.mark.parametrize("shape", ["hot", "spread", "null key"])
def test_running_values_equal_a_loop(spark, shape):
    draw = random.Random(2)
    keys = {"hot": [7], "spread": range(300), "null key": [None, 1]}[shape]
    count = {key: 0 for key in keys}
    rows = []
    for _ in range(3000):
        key = draw.choice(list(keys))
        rows.append((key, count[key] or None, draw.choice([None, *range(9)]), draw.getrandbits(40), draw.choice([None, None, "a", "b"])))
        count[key] += 1
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "key int, place int, n int, bits long, text string").repartition(5)
    result = running(frame, ["key"], ["place"], {"total": F.col("n")}, {"mixed": F.col("bits")}, {"latest": F.col("text")})
    found = [tuple(r) for r in result.select("key", "place", "total", "mixed", "latest").collect()]
    assert sorted(found, key=str) == sorted(brute(rows), key=str)


def test_equal_rows_get_different_numbers(spark):
    frame = spark.createDataFrame([(1, None)] * 500, "key int, place int").repartition(3)
    found = running(frame, ["key"], ["place"], {"number": F.lit(1)}).collect()
    assert sorted(r["number"] for r in found) == list(range(1, 501))


def test_no_rows(spark):
    frame = spark.createDataFrame([], "key int, place int")
    assert running(frame, ["key"], ["place"], {"number": F.lit(1)}).collect() == []


def test_a_hot_key_is_spread_over_ranges(spark):
    frame = spark.range(40000).select(F.lit(1).alias("key"), F.col("id").alias("place"))
    plan = running(frame, ["key"], ["place"], {"number": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(range of the scan" in plan and "SinglePartition" not in plan
