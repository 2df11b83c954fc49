"""Contexts: retrieved chunk texts in rank order, three at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioseek.config import CHUNKS_PER_CONTEXT
from folioseek.functions.prompts import PARAGRAPH_PREFIX


def _joined(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda text: F.concat(F.lit(PARAGRAPH_PREFIX), text)), "")


def _ranked(hits: DataFrame) -> DataFrame:
    """One row per question; a question has at most k hits."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "text", "source")))
    return hits.groupBy("question_id").agg(ranked.alias("ranked"))


def _group_numbers(per_group: int) -> Column:
    last = F.floor((F.size("ranked") - 1) / per_group).cast("int")
    return F.explode(F.sequence(F.lit(0), last)).alias("group_no")


def context_groups(hits: DataFrame, per_group: int = CHUNKS_PER_CONTEXT) -> DataFrame:
    """``(question_id, group_no, context, source)``; the source is that of the last chunk."""
    grouped = _ranked(hits).select("question_id", "ranked", _group_numbers(per_group))
    group = F.slice("ranked", F.col("group_no") * per_group + 1, F.lit(per_group))
    return grouped.select("question_id", "group_no", group.alias("members")).select(
        "question_id",
        "group_no",
        _joined(F.col("members.text")).alias("context"),
        F.element_at("members.source", -1).alias("source"),
    )


def running_contexts(hits: DataFrame, per_group: int = CHUNKS_PER_CONTEXT) -> DataFrame:
    """Like ``context_groups``, but each context also holds all groups before it."""
    grouped = _ranked(hits).select("question_id", "ranked", _group_numbers(per_group))
    so_far = F.slice("ranked", F.lit(1), (F.col("group_no") + 1) * per_group)
    return grouped.select("question_id", "group_no", so_far.alias("members")).select(
        "question_id", "group_no", _joined(F.col("members.text")).alias("context")
    )


def top_context(hits: DataFrame, num_chunks: int = CHUNKS_PER_CONTEXT) -> DataFrame:
    """One context per question from its first chunks only."""
    best = _ranked(hits.where(F.col("rank") <= num_chunks))
    return best.select("question_id", _joined(F.col("ranked.text")).alias("context"))
