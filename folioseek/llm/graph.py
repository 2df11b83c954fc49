"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioseek.sources.scratch import written


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its smallest node.

    Alternates large and small stars: a node tells its larger neighbours the
    smallest node that it knows, then its smaller ones. Each round is a sum per
    node and a join, written to the shared folder, so a node with a third of
    all links is split like any skewed join key and a lost executor costs one
    round. Links that stop changing are stars around the smallest nodes.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    while True:
        edges = written(_small_star(_large_star(edges)), "links")
        previous, state = state, _state(edges)
        if state == previous:
            break
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    edges = written(edges, "links")
    least = written(edges.groupBy("a").agg(F.min("b").alias("least")), "least")
    told = edges.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return told.unionByName(least.select("a", F.col("least").alias("b"))).distinct()
