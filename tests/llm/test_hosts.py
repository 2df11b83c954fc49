import numpy as np
import pytest
from pyspark.sql import functions as F

from folioseek.llm import hosts

PAGES = [
    (1, "http://A.Example.NET/en/x?q#f", '<a href="https://good.example.org/a">'),
    (2, "https://a.example.net/de/y", "<A HREF='//bad.example.com/z'>x</a><a href=/local>"),
    (3, "http://example.com/de/", '<a href="http://bad.example.com">'),
    (4, "http://bad.example.com/en/", '<a href="http://x.example.net/"><a href="http://x.example.net/2">'),
    (5, "http://x.net", None), (6, "ftp://net/?x", ""), (7, None, "<a href='http://q.org'>"), (8, "no scheme", None), (9, "http://", ""),
    (10, "http://good.example.org/fr/x", ""), (11, "http://good.example.org/FR/x", '<a href="http://good.example.org/y">'),
    (12, "x://y.org#a://b/fr/", ""), (12, "x://y.org#a://b/fr/", ""), (13, "http://notnet/", ""), (14, "http://u@h.org:80/fr/?", ""),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")


def test_hosts_paths_and_rules(spark):
    rows = {r.page_id: r for r in hosts.judged(frame(spark)).collect()}
    assert len(hosts.judged(frame(spark)).collect()) == len(PAGES)
    expected = {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("a.example.net", "/de/y", "net/", "block"),
        3: ("example.com", "/de/", "example.com/de/", "block"), 5: ("x.net", "", None, None), 6: ("net", "/", "net/", "block"),
        7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("good.example.org", "/fr/x", "org/fr/", "allow"),
        11: ("good.example.org", "/FR/x", None, None), 12: ("y.org", "", None, None), 13: ("notnet", "/", None, None), 14: ("u@h.org:80", "/fr/", None, None),
    }
    for page, (host, path, rule, verdict) in expected.items():
        assert (rows[page].host, rows[page].path, rows[page].rule) == (host, path, rule)
        assert verdict is None or rows[page].verdict == verdict


def test_ranks_equal_matrix(spark):
    pages = frame(spark).select("page_id", hosts.host(F.col("url")).alias("host"), "html")
    edges = [tuple(r) for r in hosts.edges(pages).collect()]
    names = sorted({n for a, b, _ in edges for n in (a, b)} | {"x.net", "net", "y.org", "notnet", "u@h.org:80"})
    assert ("a.example.net", "good.example.org", 1.0) in edges and ("bad.example.com", "x.example.net", 2.0) in edges
    assert ("a.example.net", "example.net", 1.0) in edges and not any(b == "net" or a == b for a, b, _ in edges)
    at = {n: i for i, n in enumerate(names)}
    links = np.zeros((len(names), len(names)))
    for a, b, w in edges:
        links[at[a], at[b]] = w
    seeds = {"trust": {"a.example.net": 1 / 2, "good.example.org": 1 / 2}, "distrust": {"a.example.net": 1 / 3, "example.com": 1 / 3, "net": 1 / 3}}
    rows = {r.host: r for r in hosts.judged(frame(spark)).collect()}
    for kind, graph in (("trust", links), ("distrust", links.T)):
        start = np.array([seeds[kind].get(n, 0.0) for n in names])
        share = graph / np.maximum(graph.sum(axis=1, keepdims=True), 1e-300)
        rank = start
        for _ in range(hosts.ROUNDS):
            rank = 0.15 * start + 0.85 * rank @ share
        for host, row in rows.items():
            if host:
                assert row[kind] == pytest.approx(rank[at[host]], abs=1e-12)


def test_empty_table(spark):
    assert hosts.judged(frame(spark, [])).count() == 0


def test_small_distrust_counts(spark):
    ranks = [(0.0, 1e-15), (1e-12, 2e-12), (0.3, 0.1 + 0.2), (1e-12, 0.0), (0.0, 0.0)]
    rows = spark.createDataFrame(ranks, "trust double, distrust double").select(hosts.suspect().alias("bad")).collect()
    assert [r.bad for r in rows] == [True, True, False, False, False]
