"""The library's inputs, derived from the test tables by Spark."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioseek.operators.embedders import HashedTerms
from folioseek.operators.index import ChunkIndex, build_index
from folioseek.sources.files import read_binary, spread_small
from folioseek.sources.scratch import fresh_path
from folioseek.sources.tables import use_database

LINES_PER_TABLE = 20

FILES_PER_PACK = 256
FAST = {"zlib.compress.level": "BEST_SPEED"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", "source", F.col("text").alias("full_text"))


def spread_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small(corpus(spark, sf_dir), "doc_id")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a form feed after each text of an id, read back as ``source, content``.

    Files are packed: with one for each document of a few kilobytes, the time
    would go into making and listing folders, which the driver does alone. A
    pack is compressed; a form feed within a file is escaped there.
    """
    path = fresh_path(spark, "files")
    documents = spread_small(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\f"))
    files = documents.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(text)), "").alias("content"))
    name = F.concat(F.lit("file-"), F.regexp_extract(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), r"^(\d*)$", 1))
    escaped = F.replace(F.replace("content", F.lit("%"), F.lit("%25")), F.lit("\f"), F.lit("%0C"))
    packed = files.select(F.concat(name, F.lit(":"), escaped).alias("value"))
    packed.write.option("maxRecordsPerFile", FILES_PER_PACK).options(lineSep="\f", compression="gzip", **FAST).text(path)
    return read_binary(spark, path, "*.txt.gz").select("content").mapInArrow(_unpacked, "source string, content binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack in batch.column("content"):
            entries = [entry.partition(b":") for entry in gzip.decompress(pack.as_py()).split(b"\f") if entry]
            sources = pa.array([name.decode() for name, _, _ in entries], pa.string())
            contents = pa.array([content.replace(b"%0C", b"\f").replace(b"%25", b"%") for _, _, content in entries], pa.binary())
            yield pa.RecordBatch.from_arrays([sources, contents], ["source", "content"])


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    return benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


_INDEXES: dict[tuple, ChunkIndex] = {}


def index(spark: SparkSession, sf_dir: str, embedder=HashedTerms()) -> ChunkIndex:
    """The index of the documents, built by the first query that needs it."""
    key = (spark.sparkContext.applicationId, sf_dir, embedder)
    if key not in _INDEXES:
        _INDEXES[key] = build_index(corpus(spark, sf_dir), fresh_path(spark, "index"), embedder=embedder)
    return _INDEXES[key]


def fresh_database(spark: SparkSession) -> str:
    """A database of its own in the shared folder; the current one stays."""
    before = spark.catalog.currentDatabase()
    name = f"folioseek_{uuid4().hex}"
    use_database(spark, name, fresh_path(spark, name))
    spark.catalog.setCurrentDatabase(before)
    return name


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread_small(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def layout_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 20 lines of a document as a table of line number, line and length.

    Every other table heads its second column with its first line; the tables
    between have no header of their own.
    """
    pos, line = F.col("pos"), F.col("line")
    table_idx = F.floor(pos / LINES_PER_TABLE).cast("int")
    row = pos % LINES_PER_TABLE
    heads = (row == 0) & (table_idx % 2 == 0)
    marked = F.when(pos % 3 == 0, F.concat(F.lit(":selected: "), line, F.lit(" "))).otherwise(line)

    def cell(column: int, kind, content):
        return F.struct(
            (row * 3 + column).alias("cell_idx"),
            F.lit(column).alias("column_index"),
            kind.alias("kind"),
            content.alias("content"),
        )

    cells = F.array(
        cell(0, F.lit("rowHeader"), pos.cast("string")),
        cell(1, F.when(heads, "columnHeader").otherwise("content"), marked),
        cell(2, F.lit("content"), F.char_length(line).cast("string")),
    )
    return document_lines(spark, sf_dir).select(
        "doc_id", table_idx.alias("table_idx"), row.alias("row_index"), F.inline(cells)
    )


def layout_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document as a paragraph; half of them repeat a table cell."""
    pos, line = F.col("pos"), F.col("line")
    place = pos % LINES_PER_TABLE
    role = F.when(place == 18, "pageFooter").when(place == 19, "pageNumber")
    repeats = F.concat(line, F.lit(" :unselected:"))
    differs = F.concat(F.lit("Note: "), line, F.lit("\n"))
    return document_lines(spark, sf_dir).select(
        "doc_id",
        pos.alias("para_idx"),
        role.alias("role"),
        F.when(pos % 2 == 0, repeats).otherwise(differs).alias("content"),
    )


# A paragraph need not be closed: it ends where the next block begins or its parent ends.
_BLOCK = r"(?=</?(?:p|article|body|footer|div|nav|h[1-6]|ul|table)\b|$)"


def _plain(markup):
    """Text of markup: line breaks are spaces, other tags are gone, entities stay as they are written."""
    return F.regexp_replace(F.regexp_replace(markup, r"(?i)<br\s*/?>", " "), r"<[^>]*>", "")


def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and footers of web pages, whole texts with the tags in them left out."""
    pages = spread_small(table(spark, sf_dir, "pages"), "page_id")

    def found(tag: str, role):
        texts = F.regexp_extract_all("html", F.lit(rf"(?s)<{tag}>(.*?){_BLOCK}"), F.lit(1))
        return F.transform(texts, lambda text: F.struct(role.alias("role"), _plain(text).alias("content")))

    both = F.concat(found("p", F.lit(None).cast("string")), found("footer", F.lit("pageFooter")))
    return pages.select(F.col("page_id").alias("doc_id"), F.posexplode(both).alias("para_idx", "entry")).select(
        "doc_id", "para_idx", "entry.role", "entry.content"
    )


def page_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link texts of web pages as the cells of one table."""
    pages = spread_small(table(spark, sf_dir, "pages"), "page_id")
    links = F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<a [^>]*>(.*?)</a>"), F.lit(1)), _plain)
    return pages.select(
        F.col("page_id").alias("doc_id"),
        F.lit(0).alias("table_idx"),
        F.posexplode(links).alias("cell_idx", "content"),
    ).select(
        "doc_id",
        "table_idx",
        "cell_idx",
        F.col("cell_idx").alias("row_index"),
        F.lit(0).alias("column_index"),
        F.lit("content").alias("kind"),
        "content",
    )


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label, as a question to the vector table."""
    vectors = table(spark, sf_dir, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(F.col("label").alias("question_id")).agg(ordered["x"].alias("embedding"))
