"""Evaluation runs, logged as tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, functions as F

from folioseek.config import CHUNKS_PER_CONTEXT, DEFAULT_K, ModelSettings
from folioseek.operators.answers import Reply
from folioseek.operators.embedders import embedder_named
from folioseek.operators.index import open_index
from folioseek.plans.answering import answer_questions_with_model
from folioseek.sources.tables import append_log, parameter_rows


def evaluation_rows(answers: DataFrame, models: Sequence[ModelSettings]) -> DataFrame:
    """``(run_name, questions, outputs, source, template)`` of answers, one run per model."""
    runs = F.array(
        *[F.struct(F.lit(m.model_id).alias("run_name"), F.lit(m.template).alias("template")) for m in models]
    )
    return answers.select(
        F.col("question").alias("questions"), F.col("answer").alias("outputs"), "source", F.inline(runs)
    ).select("run_name", "questions", "outputs", "source", "template")


def log_evaluation(answers: DataFrame, models: Sequence[ModelSettings], table: str, run_id: str | None = None) -> DataFrame:
    """Log an evaluation and return the table.

    Every call is a run of its own unless ``run_id`` names one, whose rows it replaces.
    """
    rows = evaluation_rows(answers, models).withColumn("run_id", F.lit(run_id or uuid4().hex))
    append_log(rows, table)
    return answers.sparkSession.table(table)


@dataclass(frozen=True)
class EvaluatedModel:
    """A model to evaluate: ``make`` turns the options of its settings into the function that answers a prompt.

    It is called on the executors, once per Python worker.
    """

    settings: ModelSettings
    make: Callable[[Mapping[str, str]], Callable[[str], Reply]]


def evaluate_models(
    questions: DataFrame,
    models: Sequence[EvaluatedModel],
    indexes: Mapping[str, str],
    table: str,
    run_id: str | None = None,
    k: int = DEFAULT_K,
    per_group: int = CHUNKS_PER_CONTEXT,
    **retry,
) -> DataFrame:
    """Let every model answer the questions, log what each of them said under its name, and return the table.

    A model gets the contexts that the index of its ``embedding_model`` finds
    (``indexes`` has a path for each, ``register_embedder`` its embedder), in
    its own template. All runs are logged together.
    """
    spark, run_id = questions.sparkSession, run_id or uuid4().hex
    opened = {name: open_index(spark, path, embedder_named(name)) for name, path in indexes.items()}
    runs = []
    for model in models:
        settings = model.settings
        options, make = dict(settings.options), model.make
        answers = answer_questions_with_model(
            questions,
            opened[settings.embedding_model],
            k=k,
            per_group=per_group,
            template=settings.template,
            load=lambda options=options, make=make: make(options),
            model_name=f"{run_id} {settings.model_id} {sorted(options.items())}",
            **retry,
        )
        runs.append(evaluation_rows(answers, [settings]))
    rows = reduce(DataFrame.unionByName, runs).withColumn("run_id", F.lit(run_id))
    append_log(rows, table)
    return spark.table(table)


def dataset_digest(*columns: Column) -> Column:
    """Digest of a set of rows that does not depend on their order."""
    row = F.md5(F.concat_ws("\u0001", *columns))
    return F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("long"))


def run_parameters(questions: DataFrame, dataset: str, models: Sequence[ModelSettings]) -> DataFrame:
    """``(run_name, key, value)``: settings of each model, and the questions it was given."""
    names = sorted({name for model in models for name in model.options})
    runs = [
        F.struct(
            F.lit(model.model_id).alias("run_name"),
            F.lit(model.model_id).alias("model_id"),
            F.lit(model.embedding_model).alias("embedding_model"),
            *[F.lit(model.options.get(name)).cast("string").alias(name) for name in names],
        )
        for model in models
    ]
    profile = questions.agg(
        F.count(F.lit(1)).alias("dataset_rows"),
        dataset_digest(F.col("question")).alias("dataset_digest"),
    ).withColumn("dataset", F.lit(dataset))
    return parameter_rows(profile.select("*", F.inline(F.array(*runs))), "run_name")


def log_run_parameters(
    questions: DataFrame, dataset: str, models: Sequence[ModelSettings], table: str, run_id: str | None = None
) -> DataFrame:
    """Log the parameters of a run, as ``log_evaluation`` does its rows."""
    rows = run_parameters(questions, dataset, models).withColumn("run_id", F.lit(run_id or uuid4().hex))
    append_log(rows, table)
    return questions.sparkSession.table(table)
