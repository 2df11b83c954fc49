"""Files to a corpus table and an index."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from folioseek.config import ChunkSettings
from folioseek.operators.embedders import HashedTerms
from folioseek.operators.index import ChunkIndex, build_index
from folioseek.operators.layout import flatten_layout
from folioseek.sources.files import analyze_layout, decode_pages, layout_rows, raw_corpus
from folioseek.sources.scratch import owned
from folioseek.sources.tables import save_corpus


def page_corpus(files: DataFrame, decode: Callable[[bytes], Sequence[str]]) -> DataFrame:
    """``doc_id, source, page, full_text``: each page of a file is a document, named by both."""
    doc_id = F.concat(F.col("source"), F.lit("#page="), F.col("page").cast("string"))
    return decode_pages(files, decode).select(doc_id.alias("doc_id"), "source", "page", "full_text")


def layout_corpus(files: DataFrame, analyze: Callable[[bytes], dict[str, list[dict]]]) -> DataFrame:
    """``doc_id, source, full_text``: each file is a document, its layout flattened."""
    paragraphs, cells = layout_rows(analyze_layout(files, analyze))
    return flatten_layout(paragraphs, cells).withColumn("source", F.col("doc_id"))


def ingest(
    files: DataFrame,
    table: str,
    path: str,
    decode: Callable[[bytes], Sequence[str]] | None = None,
    analyze: Callable[[bytes], dict[str, list[dict]]] | None = None,
    settings: ChunkSettings = ChunkSettings(),
    embedder=HashedTerms(),
) -> ChunkIndex:
    """Replace a corpus table and an index by what ``files(source, content)`` hold.

    With ``analyze`` the files go through a layout service, with ``decode``
    page by page; exactly one of them is given.
    """
    if (decode is None) == (analyze is None):
        raise ValueError("either decode or analyze is given")
    use_layout = analyze is not None
    # What a layout service found is not read again once the corpus is saved.
    with owned(files.sparkSession):
        layouts = layout_corpus(files, analyze) if use_layout else None
        pages = None if use_layout else page_corpus(files, decode)
        corpus = raw_corpus(use_layout, layouts, pages).select("doc_id", "source", "page", "full_text")
        saved = save_corpus(corpus, table)
    return build_index(saved, path, settings, embedder)
