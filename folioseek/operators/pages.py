"""Pages, lengths and counts of raw documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioseek.functions.text import let


def page_texts(text: Column, lines_per_page: int = 20) -> Column:
    """Texts of the pages of a document, ``lines_per_page`` lines each."""

    def cut(lines: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(lines_per_page))
        return F.transform(starts, lambda i: F.array_join(F.slice(lines, i + 1, F.lit(lines_per_page)), "\n"))

    return let(F.split(F.coalesce(text, F.lit("")), "\n"), cut)


def split_pages(
    documents: DataFrame, text: str = "text", lines_per_page: int = 20, page_mark: str | None = None
) -> DataFrame:
    """One row per page, numbered from 0; pages are cut inside the row, without a shuffle.

    ``page_mark``, such as a form feed, ends a page instead of a line count.
    """
    if page_mark is None:
        pages = page_texts(F.col(text), lines_per_page)
    else:
        pages = F.split(F.coalesce(F.col(text), F.lit("")), f"\\Q{page_mark}\\E")
    kept = [name for name in documents.columns if name != text]
    return documents.select(*kept, F.posexplode(pages).alias("page", "full_text"))


def longest_document(corpus: DataFrame, text: str = "full_text", tie_break: str = "doc_id") -> DataFrame:
    """The longest text; equal lengths go to the smallest ``tie_break``."""
    return (
        corpus.withColumn("n_chars", F.char_length(text).cast("long"))
        .orderBy(F.desc("n_chars"), F.asc(tie_break))
        .limit(1)
    )


def count_rows(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count(F.lit(1)).alias("num_rows"))
