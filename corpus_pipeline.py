"""The corpus pipeline: documents to a clean, mixed training corpus in five stages.

Every stage takes ``(spark, docs, sf_dir)``, works on all that the stage before
it kept, and returns a DataFrame that is written as Parquet and read again as
the ``docs`` of the next. All but the last return the columns of ``docs``; the
last adds how often a document is taken. Empty tables and null columns pass
through every stage; what a stage does with null, empty or repeated rows is
said in the module that it calls.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioseek.llm import decontamination, language, mixing, near_duplicates, surrogates
from folioseek.llm.common import table
from folioseek.sources.scratch import written
from folioseek.sources.session import ship_packages

# A production run passes a secret of its own to ``surrogates.replaced``.
SURROGATE_KEY = "test run"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; learned from all documents with a ``lang``."""
    samples = language.dictionaries(docs)
    return language.predicted(docs, samples).where(language.accepted()).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words to a shingle, a similarity of 0.8."""
    gone = near_duplicates.near_duplicates(docs, shingle_words=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(written(gone, "duplicates"), "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no question of the benchmark together with its answer."""
    items = decontamination.parted(table(spark, sf_dir, "benchmark"))
    return decontamination.searched(docs, items).where(decontamination.clean()).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced by surrogates; ``n_chars`` follows the new text."""
    changed = surrogates.replaced(docs, SURROGATE_KEY)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.col("n_entities") > 0, length).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``."""
    return mixing.mixed(docs).where("copies > 0")


def _shipped(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_packages(spark, Path(__file__).resolve().parent, "folioseek")
        return stage(spark, docs, sf_dir)

    run.__doc__ = stage.__doc__
    return run


STAGES = [
    ("language", _shipped(identify_language)),
    ("near_duplicates", _shipped(drop_near_duplicates)),
    ("benchmark_leaks", _shipped(drop_benchmark_leaks)),
    ("personal_data", _shipped(replace_personal_data)),
    ("mix", _shipped(mix_sources)),
]

# Compression, min-max hashing and keyed surrogates cannot be said in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
