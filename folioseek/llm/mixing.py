"""Mixing sources to target weights by Pareto order sampling.

A source gets a number of words. Every document of it has an expected number
of copies, in proportion to its weight and at most two; the whole copies of it
are certain. The rest is a Pareto sample: documents are ranked by
``(u / (1 - u)) / (p / (1 - p))``, with ``u`` from a hash of the document and
``p`` the fraction of a copy that is left, and the smallest ranks are taken
until the words that are left to the source are reached, to the nearest
document. Everything comes from hashes and whole numbers, so reruns agree.

Ranks are never sorted as a whole: words are summed in bins of the rank, the
bin in which the target lies is binned again, and only what is left of the
last bin is put in order. A source with a third of all rows is therefore
summed like any other.

A null text has no words; a document without words is taken no time. A null
source is a source, the last. Rows that repeat a ``doc_id``, or have none, share a rank and
stand next to each other; where the target falls among equal ones, so many of them are taken.
Other columns pass through; results replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioseek.llm.common import words
from folioseek.operators.scans import running
from folioseek.sources.scratch import written

WEIGHTS = (5, 2, 1)
PERCENT = 150
MOST_COPIES = 2
LEVELS = 64
BINS = 4096
LEVEL = "weight level"
RESULTS = ("size", "source_size", "target", "copies", "taken", LEVEL)


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT) -> DataFrame:
    """``source, source_size, target`` from one row ``source, source_size`` for each source.

    Sources by code point, null last, get the weights in turn. A target stops
    at twice its source's size; the excess goes to the others by weight. The
    sources that stop are those with the least size for their weight, so they
    are found in one pass in that order.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight)
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, on, all_ = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    rows = rows.select(
        "*",
        (F.sum("source_size").over(all_) * percent / 100.0).alias("wanted"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.sum("weight").over(on).alias("weight_on"),
    )
    share = (F.col("wanted") - MOST_COPIES * F.col("size_before")) / F.col("weight_on")
    rows = rows.withColumn("share", share).withColumn("stops", F.col("share") * F.col("weight") > MOST_COPIES * F.col("source_size"))
    free = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "share")))
    rows = rows.withColumn("free_share", free.over(all_)["share"])
    target = F.when(F.col("stops"), (MOST_COPIES * F.col("source_size")).cast("double")).otherwise(F.col("free_share") * F.col("weight"))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def _hashed(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from the document's id."""
    digits = F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(str(seed)))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _copies(levels: DataFrame) -> DataFrame:
    """``source, level, wanted``: expected copies of a document, at most two, so that the source comes to its target.

    ``levels`` has one row for each source and weight level, so a source has
    at most ``LEVELS`` rows here. Levels that reach the limit are the highest.
    """
    order = W.partitionBy("source").orderBy(F.desc("level"))
    above, on = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    rows = levels.select(
        "*",
        F.coalesce(F.sum("words").over(above), F.lit(0)).alias("words_above"),
        F.sum(F.col("words") * F.col("level")).over(on).alias("mass_on"),
    )
    factor = F.try_divide(F.col("target") - MOST_COPIES * F.col("words_above"), F.col("mass_on"))
    rows = rows.withColumn("factor", factor).withColumn("limited", F.coalesce(F.col("factor") * F.col("level") >= MOST_COPIES, F.lit(True)))
    free = F.max(F.when(~F.col("limited"), F.struct("level", "factor"))).over(W.partitionBy("source"))["factor"]
    copies = F.when(F.col("limited"), F.lit(float(MOST_COPIES))).otherwise(free * F.col("level"))
    return rows.select("source", "level", copies.alias("wanted"), "words", "target")


def distinct_share(found: Column) -> Column:
    """The share of a text's words that are different words: long repetitions are preferred less."""
    return F.try_divide(F.size(F.array_distinct(found)), F.size(found))


def sized(documents: DataFrame, weight: Callable[[Column], Column] | None = None) -> DataFrame:
    """The documents with ``size`` (words) and the level of their weight."""
    found = documents.withColumn("words of the text", words(F.col("text")))
    level = F.lit(LEVELS)
    if weight is not None:
        level = F.greatest(F.lit(1), F.least(F.lit(LEVELS), F.round(F.coalesce(weight(F.col("words of the text")), F.lit(1.0)) * LEVELS)))
    return found.select(
        *[c for c in documents.columns if c not in RESULTS], F.size("words of the text").cast("long").alias("size"), level.cast("long").alias(LEVEL)
    )


def plan(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, seed: int = 1) -> DataFrame:
    """One row for each source and level: whole copies, the rest of a copy, and the rank at which the sample ends.

    ``sizes``, the columns ``doc_id, source, size`` and the level of ``sized``, is read several times and should be a written table.
    """
    levels = written(sizes.groupBy("source", F.col(LEVEL).alias("level")).agg(F.sum("size").alias("words")), "levels")
    goal = targets(levels.groupBy("source").agg(F.sum("words").alias("source_size")), weights, percent)
    goal = written(goal.withColumnRenamed("source", "of"), "targets")
    copies = _copies(levels.join(goal, _same("source", "of")).select("source", "level", "words", "target"))
    copies = written(
        copies.select(
            F.col("source").alias("of"),
            F.col("level").alias("at"),
            F.floor("wanted").alias("whole"),
            (F.col("wanted") - F.floor("wanted")).alias("part"),
            "words",
            "target",
        ),
        "copies",
    )
    left = copies.groupBy("of").agg((F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("left"))
    fractions = copies.select("of", "at", "whole", "part")
    ranked = sizes.select("doc_id", "source", "size", LEVEL).join(fractions, _same("source", "of") & (F.col(LEVEL) == F.col("at")))
    ranked = written(ranked.withColumn("rank", _rank(seed, F.col("part"))).where("rank is not null").select("doc_id", "size", "of", "rank"), "ranked")
    cuts = _cuts(ranked, written(left, "left"))
    rows = fractions.join(goal.withColumnRenamed("of", "goal_of"), _same("of", "goal_of")).drop("goal_of")
    return written(rows.join(cuts, _same("of", "cut_of"), "left").drop("cut_of"), "plan")


def taken(sizes: DataFrame, made: DataFrame, seed: int = 1) -> DataFrame:
    """``sizes`` with ``source_size``, ``target``, ``copies`` and ``taken`` (words, repeats counted); ``made`` is its plan."""
    plan_of = {c: F.col(f"plan {c}") for c in made.columns}
    rank = F.col("plan rank")
    rows = sizes.join(
        made.select(*[F.col(c).alias(f"plan {c}") for c in made.columns]),
        F.col("source").eqNullSafe(plan_of["of"]) & (F.col(LEVEL) == plan_of["at"]),
    ).withColumn("plan rank", _rank(seed, plan_of["part"]))
    own = F.struct(rank.alias("rank"), "doc_id", "size")
    rows = _numbered(rows, own == plan_of["limit"], made)
    first, second = _bin(rank, F.lit(0.0), F.lit(1.0)), _bin(rank, plan_of["next_low"], plan_of["next_high"])
    first_bin, second_bin = plan_of["first_bin"], plan_of["second_bin"]
    inside = (
        F.when(rank.isNull(), False)
        .when(first_bin.isNull(), True)
        .when(first != first_bin, first < first_bin)
        .when(second_bin.isNull(), True)
        .when(second != second_bin, second < second_bin)
        .otherwise(F.coalesce((own < plan_of["limit"]) | ((own == plan_of["limit"]) & (F.coalesce("plan number", F.lit(1)) <= plan_of["ties"])), F.lit(False)))
    )
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(plan_of["whole"] + inside.cast("int")).cast("long")
    kept = [c for c in sizes.columns if c not in (LEVEL, "source_size", "target", "copies", "taken")]
    found = rows.select(*kept, plan_of["source_size"].alias("source_size"), plan_of["target"].alias("target"), copies.alias("copies"))
    return found.withColumn("taken", F.col("copies") * F.col("size"))


def _numbered(rows: DataFrame, is_tie: Column, made: DataFrame) -> DataFrame:
    """``rows`` with ``plan number`` where rows are equal in rank, id and size and not all of them are taken.

    Only such rows are numbered, in ranges of any size; hardly ever are there any.
    """
    none = F.lit(None).cast("long").alias("plan number")
    if made.where("ties < tie_rows").isEmpty():
        return rows.select("*", none)
    is_tie = F.coalesce(is_tie & (F.col("plan ties") < F.col("plan tie_rows")), F.lit(False))
    order = ["doc_id", *(["text"] if "text" in rows.columns else [])]
    ties = running(rows.where(is_tie), ["plan of"], order, {"plan number": F.lit(1)})
    return rows.where(~is_tie).select("*", none).unionByName(ties.withColumn("plan number", F.col("plan number").cast("long")))


def mixed(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    percent: int = PERCENT,
    weight: Callable[[Column], Column] | None = distinct_share,
    seed: int = 1,
) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``weight`` tells from the words how much a document is preferred within its
    source (0 to 1, rounded to ``LEVELS`` levels); without it all are equal.
    Texts are read twice and do not shuffle while the plan, of ``LEVELS`` rows
    for each source at most, is small enough for Spark to send it around.
    """
    sizes = written(sized(documents.select("doc_id", "source", "text"), weight).select("doc_id", "source", "size", LEVEL), "sizes")
    return taken(sized(documents, weight), plan(sizes, weights, percent, seed), seed)


def _rank(seed: int, part: Column) -> Column:
    u = _hashed(F.col("doc_id"), seed)
    return F.when((part > 0) & (F.col("size") > 0), (u / (1 - u)) / (part / (1 - part)))


def _bin(rank: Column, low: Column, high: Column) -> Column:
    place = F.floor((rank / (1 + rank) - low) / (high - low) * BINS)
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place)).cast("long")


def _boundary(rows: DataFrame) -> DataFrame:
    """The bin of each source in which ``left`` words are reached, and what is left at its start."""
    sums = rows.groupBy("of", "left", "low", "high", _bin(F.col("rank"), F.col("low"), F.col("high")).alias("bin")).agg(F.sum("size").alias("words"))
    order = W.partitionBy("of").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    found = sums.withColumn("up_to", F.sum("words").over(order)).where("up_to >= left")
    least = F.min(F.struct("bin", "up_to", "words", "left", "low", "high")).alias("found")
    step = (F.col("found.high") - F.col("found.low")) / BINS
    return found.groupBy("of").agg(least).select(
        "of",
        (F.col("found.left") - F.col("found.up_to") + F.col("found.words")).alias("left"),
        F.col("found.bin").alias("bin"),
        (F.col("found.low") + F.col("found.bin") * step).alias("next_low"),
        (F.col("found.low") + (F.col("found.bin") + 1) * step).alias("next_high"),
    )


def _cuts(ranked: DataFrame, left: DataFrame) -> DataFrame:
    """Where the sample of each source ends: in the order of ranks, the middle of a document lies within the words left."""
    goal = left.select(F.col("of").alias("goal_of"), "left", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    first = written(_boundary(ranked.join(goal, _same("of", "goal_of"))).withColumnRenamed("of", "cut_of"), "bins")
    near = ranked.join(first, _same("of", "cut_of")).where(_bin(F.col("rank"), F.lit(0.0), F.lit(1.0)) == F.col("bin"))
    near = written(near.drop("bin", "cut_of").withColumnsRenamed({"next_low": "low", "next_high": "high"}), "near")
    second = written(_boundary(near).select(F.col("of").alias("in_of"), "left", F.col("bin").alias("second_bin")), "bins")
    last = near.drop("left").join(second, _same("of", "in_of")).where(_bin(F.col("rank"), F.col("low"), F.col("high")) == F.col("second_bin"))
    # Rows that are equal in rank, id and size are one group, of which some may be taken.
    groups = last.groupBy("of", "left", "rank", "doc_id", "size").agg(F.count("*").alias("rows"))
    order = W.partitionBy("of").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    before = F.sum(F.col("rows") * F.col("size")).over(order) - F.col("rows") * F.col("size")
    fitting = F.floor((F.col("left") - F.col("before")) / F.col("size") + 0.5)
    groups = groups.withColumn("before", before).withColumn("ties", F.least("rows", fitting)).where("ties > 0")
    best = F.max(F.struct("rank", "doc_id", "size", "ties", "rows")).alias("best")
    limit = groups.groupBy("of").agg(best).select(
        F.col("of").alias("limit_of"), F.struct("best.rank", "best.doc_id", "best.size").alias("limit"), "best.ties", F.col("best.rows").alias("tie_rows")
    )
    cuts = first.select("cut_of", F.col("bin").alias("first_bin"), "next_low", "next_high")
    cuts = cuts.join(second.select("in_of", "second_bin"), _same("cut_of", "in_of"), "left").drop("in_of")
    return cuts.join(limit, _same("cut_of", "limit_of"), "left").drop("limit_of")
