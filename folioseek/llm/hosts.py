"""URL verdicts: rules first, then trust and distrust spread over the graph of hosts.

Rules name a host and the start of a path. For pages without a rule the host
decides. Hosts with allowed pages are trusted and hosts with blocked pages are
blocked seeds, by their share of such pages. Personalised PageRank carries trust along links
from the first, and distrust against the direction of links from the second:
who links to bad hosts is suspect. A host whose distrust exceeds its trust is
blocked.

Edges between hosts are hyperlinks of the pages, counted, and for every host
one edge to and one from its parent domain, as sites answer for their
subdomains; hosts without links to others still get a verdict this way. A
parent domain need not have pages itself. The last label of a host is never a
parent.

A url that is null or has no ``://`` has an empty host and an empty path, fits
no rule, and is allowed. A null page has no links. Other columns are not read.
Column functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioseek.llm.common import let, lowered
from folioseek.sources.scratch import written

# host, path, verdict
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
DAMPING = 0.85
ROUNDS = 12
LINK = r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host(url: Column) -> Column:
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """The pages with the longest rule that fits (``rule``) and what it says (``ruled``), or nulls."""
    longest_first = sorted(rules, key=lambda rule: (-len(rule[0] + rule[1]), rule))
    fits = F.lit(None).cast("string")
    says = F.lit(None).cast("string")
    for of, start, verdict in reversed(longest_first):
        inside = (F.col("host") == of) | F.endswith("host", F.lit(f".{of}"))
        match = inside & F.startswith("path", F.lit(start))
        fits, says = F.when(match, f"{of}{start}").otherwise(fits), F.when(match, verdict).otherwise(says)
    return pages.withColumns({"rule": fits, "ruled": says})


def _parents(labels: Column) -> Column:
    """A host and its parent domains of two labels and more."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def edges(pages: DataFrame) -> DataFrame:
    """``source, target, weight``: hyperlinks between different hosts, and each host with its parent both ways."""
    links = pages.where("host <> ''").select(
        F.col("host").alias("source"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("target")
    )
    links = links.withColumn("target", lowered(F.col("target"))).where("source <> target")
    links = written(links.groupBy("source", "target").agg(F.count("*").cast("double").alias("weight")), "links")
    known = pages.where("host <> ''").select("host").union(links.select("target")).distinct()
    chain = known.select(F.explode(_pairs(F.split("host", r"\."))).alias("pair")).select("pair.*").distinct()
    back = chain.select(F.col("target").alias("source"), F.col("source").alias("target"))
    structure = chain.unionByName(back).withColumn("weight", F.lit(1.0))
    return links.unionByName(structure).groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def _pairs(labels: Column) -> Column:
    return let(
        _parents(labels),
        lambda names: F.transform(
            F.slice(names, 1, F.size(names) - 1), lambda name, i: F.struct(name.alias("source"), F.get(names, i + 1).alias("target"))
        ),
    )


def spread(found: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``host, trust, distrust`` after so many rounds, from ``seeds(host, trust, distrust)`` that each sum to one.

    ``found`` holds the edges. One sum and one join per round carry both: an
    edge is written once in its direction for trust and once against it for
    distrust, with its share of what its end gives away. Every third round is
    written to the shared folder, which cuts the lineage. A host without an
    edge to give along gives nothing away.
    """
    both = found.select("source", "target", "weight", F.lit(True).alias("forward")).unionByName(
        found.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight", F.lit(False).alias("forward"))
    )
    given = both.groupBy("source", "forward").agg(F.sum("weight").alias("given"))
    shares = both.join(given, ["source", "forward"]).select(
        F.col("source").alias("giver"), "target", "forward", (F.col("weight") / F.col("given")).alias("share")
    )
    shares = written(shares.repartition("giver"), "shares")
    start = written(seeds.select("host", (1 - damping) * F.col("trust"), (1 - damping) * F.col("distrust")).toDF("host", "trust", "distrust"), "seeds")
    ranks = seeds.select("host", "trust", "distrust")
    for step in range(1, rounds + 1):
        gained = F.when(F.col("forward"), F.col("trust")).otherwise(F.col("distrust")) * F.col("share") * damping
        moved = shares.join(ranks, F.col("giver") == F.col("host")).select(
            F.col("target").alias("host"),
            F.when(F.col("forward"), gained).otherwise(0.0).alias("trust"),
            F.when(F.col("forward"), 0.0).otherwise(gained).alias("distrust"),
        )
        ranks = moved.unionByName(start).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if step % 3 == 0 or step == rounds:
            ranks = written(ranks, "ranks")
    return ranks


def suspect() -> Column:
    """Whether ``distrust`` exceeds ``trust``, relative to its size, as ranks fall with the number of seeds."""
    return F.col("distrust") > F.col("trust") * (1 + 1e-9)


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages(page_id, url, html)``, and the host's trust and distrust."""
    known = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "html")
    ruled = with_rule(known, rules)
    counts = written(
        ruled.where("host <> ''")
        .groupBy("host")
        .agg(
            F.count(F.when(F.col("ruled") == "allow", 1)).alias("allowed"),
            F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"),
        ),
        "hosts",
    )
    total = counts.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
    seeds = counts.select(
        "host",
        (F.col("allowed") / float(total["allowed"] or 1)).alias("trust"),
        (F.col("blocked") / float(total["blocked"] or 1)).alias("distrust"),
    )
    ranks = spread(edges(known), seeds, rounds)
    verdicts = written(
        ranks.select(F.col("host").alias("of"), "trust", "distrust", F.when(suspect(), "block").otherwise("allow").alias("verdict")), "verdicts"
    )
    return (
        ruled.drop("html")
        .join(verdicts, F.col("host") == F.col("of"), "left")
        .select("page_id", "host", "path", "rule", F.coalesce("ruled", "verdict", F.lit("allow")).alias("verdict"), "trust", "distrust")
    )
