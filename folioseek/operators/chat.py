"""Chat history as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def chat_history(turns: DataFrame, asker: str = "user", answerer: str = "assistant") -> DataFrame:
    """``(conv_id, turn, question, answer)``: a question and the answer right after it.

    The history of a conversation is its rows in the order of ``turn``. Pairs
    are joined on conversation and turn together, so a conversation of any
    length is spread over all tasks.
    """
    asked = turns.where(F.col("role") == asker).select("conv_id", "turn", F.col("text").alias("question"))
    given = turns.where(F.col("role") == answerer).select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(given, ["conv_id", "turn"])


def append_turns(history: DataFrame, answers: DataFrame) -> DataFrame:
    """History rows with one more row per answered ``(conv_id, turn, question, answer)``."""
    return history.unionByName(answers.select("conv_id", "turn", "question", "answer"))
