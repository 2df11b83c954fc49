"""Files to raw pages and raw documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioseek.sources.scratch import written

# The size of a file split that Spark aims at by default.
SPLIT_BYTES = 128 * 1024 * 1024

PAGE_SCHEMA = "full_text string, source string, page int"


def read_binary(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """All files below ``folder`` as ``(source, content)``."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(folder)
        .select(F.col("path").alias("source"), "content")
    )


def decode_pages(
    files: DataFrame, decode: Callable[[bytes], Sequence[str]], batch_files: int = 16
) -> DataFrame:
    """One row per page of each file, numbered from 0.

    ``decode`` turns the bytes of one file into its page texts. It runs on the
    executors, a few files at a time, so a task holds no more than those.
    """

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_files):
                rows = [
                    (text, row.source, page)
                    for row in batch.iloc[start : start + batch_files].itertuples()
                    for page, text in enumerate(decode(bytes(row.content)))
                ]
                yield pd.DataFrame(rows, columns=["full_text", "source", "page"])

    return files.select("source", "content").mapInPandas(pages, PAGE_SCHEMA)


LAYOUT_SCHEMA = """
    source string,
    paragraphs array<struct<role: string, content: string>>,
    cells array<struct<table_idx: int, cell_idx: int, row_index: int, column_index: int, kind: string, content: string>>
"""


def analyze_layout(
    files: DataFrame, analyze: Callable[[bytes], dict[str, list[dict]]], batch_files: int = 16
) -> DataFrame:
    """One row per file with its ``paragraphs`` and table ``cells``, as a layout service finds them.

    ``analyze`` turns the bytes of one file into these two lists, with the
    fields of ``LAYOUT_SCHEMA``. The result is written to the shared folder:
    it is read for paragraphs and for cells, and a service should be asked once.
    """

    def results(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_files):
                part = batch.iloc[start : start + batch_files]
                found = [analyze(bytes(content)) for content in part["content"]]
                yield pd.DataFrame(
                    {
                        "source": part["source"].to_list(),
                        "paragraphs": [result["paragraphs"] for result in found],
                        "cells": [result["cells"] for result in found],
                    }
                )

    return written(files.select("source", "content").mapInPandas(results, LAYOUT_SCHEMA), "layouts", compression="zstd")


def layout_rows(layouts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paragraph rows and cell rows of analyzed files; the file is the document."""
    document = F.col("source").alias("doc_id")
    paragraphs = layouts.select(document, F.posexplode("paragraphs").alias("para_idx", "entry"))
    cells = layouts.select(document, F.inline("cells"))
    return paragraphs.select("doc_id", "para_idx", "entry.role", "entry.content"), cells


def read_text_documents(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """One row per text file, without a page number."""
    return (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(folder)
        .select(
            F.col("value").alias("full_text"),
            F.col("_metadata.file_path").alias("source"),
            F.lit(None).cast("int").alias("page"),
        )
    )


def raw_corpus(use_layout: bool, layout_documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Pick the source of the corpus by a flag; the other one is never read."""
    chosen = layout_documents if use_layout else pages
    page = F.col("page") if "page" in chosen.columns else F.lit(None).cast("int")
    return chosen.withColumn("page", page)


def spare_cores(df: DataFrame) -> int | None:
    """How many tasks to spread an input over that is too small to fill the cores.

    None for anything that is read from as many files as there are cores, or
    from files that together make up a split per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not 0 < len(files) < cores:
        return None
    lengths = df.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length"))
    return cores if lengths.first()[0] < cores * SPLIT_BYTES else None


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for a small input; a large one is returned as it is, without a shuffle."""
    tasks = spare_cores(df)
    return df if tasks is None else df.repartition(tasks, *keys)
