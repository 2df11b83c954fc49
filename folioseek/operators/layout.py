"""Layout results (paragraphs and table cells) to text.

``cells``: ``doc_id, table_idx, cell_idx, row_index, column_index, kind, content``.
``paragraphs``: ``doc_id, para_idx, role, content``.

A document may hold any share of all rows. Work is therefore cut into blocks
of cells (or paragraphs) that follow each other, and only short summaries of
blocks are brought together per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioseek.functions.text import clean_layout_text, drop_selection_marks

# Roles of paragraphs that are left out, kinds of cells, heading line.
LEFT_OUT_ROLES = ("pageNumber", "pageFooter")
CONTENT_KIND = "content"
HEADER_KIND = "columnHeader"
TABLE_LINE = "Below is a Table:"

# The section of texts of cells where paragraphs that repeat them are left out, before those of paragraphs and tables.
CELL_TEXT = -1

# Cells or paragraphs per block.
BLOCK_ROWS = 4096

BLOCK = ("doc_id", "table_idx", "blk")


def kept_paragraphs(paragraphs: DataFrame, cells: DataFrame) -> DataFrame:
    """``(doc_id, para_idx, role, clean)`` of the paragraphs that are printed.

    A paragraph is left out for its role, or when its clean text is the clean
    text of a cell of the same document. A paragraph without a role is kept.
    """
    left_out = F.coalesce(F.col("role"), F.lit("")).isin(*LEFT_OUT_ROLES)
    # Not made distinct: an anti join does not need it, and a sum above the
    # shuffle would keep adaptive execution from splitting a hot text. Both sides
    # grow with the corpus, and a merge join spills where it has to.
    cell_texts = cells.select("doc_id", clean_layout_text(F.col("content")).alias("clean"))
    cleaned = paragraphs.where(~left_out).withColumn("clean", clean_layout_text(F.col("content")))
    return cleaned.join(cell_texts.hint("merge"), ["doc_id", "clean"], "left_anti").select(
        "doc_id", "para_idx", "role", "clean"
    )


def _in_blocks(cells: DataFrame, block_rows: int) -> DataFrame:
    block = F.floor(F.col("cell_idx") / block_rows).cast("int")
    return cells.withColumn("blk", block).withColumn("content", drop_selection_marks(F.col("content")))


def _carried_headers(blocked: DataFrame, reset_per_table: bool) -> DataFrame:
    """Per block, the last header of each column in earlier blocks of the document or table."""
    # Only headers move here, and one row for each column of a block, not the cells.
    columns = blocked.select(*BLOCK, "column_index").distinct()
    headers = blocked.where(F.col("kind") == HEADER_KIND).groupBy(*BLOCK, "column_index")
    last_headers = columns.join(
        headers.agg(F.max_by("content", "cell_idx").alias("header")), [*BLOCK, "column_index"], "left"
    )
    scope = ["doc_id", "table_idx"] if reset_per_table else ["doc_id"]
    before = (
        Window.partitionBy(*scope, "column_index")
        .orderBy("table_idx", "blk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = last_headers.withColumn("carried", F.last("header", ignorenulls=True).over(before))
    entry = F.struct("column_index", "carried")
    # One map per block, so that joining it needs the blocks' own partitioning
    # and the cells are not shuffled again. A block has few columns.
    return (
        carried.where(F.col("carried").isNotNull())
        .groupBy(*BLOCK)
        .agg(F.map_from_entries(F.collect_list(entry)).alias("carried"))
    )


def with_headings(
    cells: DataFrame, reset_per_table: bool = False, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Cells with ``heading``: the latest column header at or before the cell.

    Headers stay in force from one table of a document to the next unless
    ``reset_per_table``. Selection marks are gone from ``content``.
    """
    return _with_headings(_in_blocks(cells, block_rows), reset_per_table)


def _with_headings(blocked: DataFrame, reset_per_table: bool) -> DataFrame:
    so_far = (
        Window.partitionBy(*BLOCK, "column_index")
        .orderBy("cell_idx")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    header = F.when(F.col("kind") == HEADER_KIND, F.col("content"))
    local = blocked.repartition(*BLOCK).withColumn("heading", F.last(header, ignorenulls=True).over(so_far))
    return (
        local.join(_carried_headers(blocked, reset_per_table), list(BLOCK), "left")
        .withColumn("heading", F.coalesce("heading", F.col("carried")[F.col("column_index")]))
        .drop("carried")
    )


def cell_line(heading: Column) -> Column:
    """The printed line of a cell."""
    place = F.format_string("Cell[%d][%d]", "row_index", "column_index")
    text = F.concat(F.lit(" has text '"), F.col("content"), F.lit("'"))
    return (
        F.when(F.col("kind") != CONTENT_KIND, F.concat(place, F.lit(" as "), F.col("kind"), text))
        .when(heading.isNull(), F.concat(place, text))
        .otherwise(F.concat(place, F.lit(" with column heading '"), heading, F.lit("'"), text))
    )


def cell_lines(cells: DataFrame, reset_per_table: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(doc_id, table_idx, cell_idx, line)``."""
    headed = with_headings(cells, reset_per_table, block_rows)
    return headed.select("doc_id", "table_idx", "cell_idx", cell_line(F.col("heading")).alias("line"))


def _concatenated(order: str, line: str) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct(order, F.col(line).alias("line"))))
    return F.array_join(F.transform(ordered, lambda entry: entry["line"]), "")


def layout_blocks(
    paragraphs: DataFrame, cells: DataFrame, reset_per_table: bool = False, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Printed text in blocks ``(doc_id, section, table_idx, blk, text)`` of at most ``block_rows`` lines.

    Section 0 holds paragraphs, section 1 tables. Every document has a block,
    if only an empty one.
    """
    block = F.floor(F.col("para_idx") / block_rows).cast("int").alias("blk")
    lines = kept_paragraphs(paragraphs, cells).select("doc_id", block, "para_idx", F.concat("clean", F.lit("\n")).alias("line"))
    # A row for each block stands for the paragraphs left out, whose texts need not move.
    empty = paragraphs.select("doc_id", block).distinct().select("*", F.lit(None).cast(lines.schema["para_idx"].dataType).alias("para_idx"), F.lit("").alias("line"))
    paragraph_blocks = (
        lines.unionByName(empty)
        .groupBy("doc_id", "blk")
        .agg(_concatenated("para_idx", "line").alias("text"))
        .select("doc_id", F.lit(0).alias("section"), F.lit(-1).alias("table_idx"), "blk", "text")
    )
    return paragraph_blocks.unionByName(_table_blocks(cells, reset_per_table, block_rows))


def _table_blocks(cells: DataFrame, reset_per_table: bool, block_rows: int) -> DataFrame:
    headed = _with_headings(_in_blocks(cells, block_rows), reset_per_table)
    return (
        headed.withColumn("line", F.concat(cell_line(F.col("heading")), F.lit("\n")))
        .groupBy(*BLOCK)
        .agg(_concatenated("cell_idx", "line").alias("text"))
        .select(
            "doc_id",
            F.lit(1).alias("section"),
            "table_idx",
            "blk",
            F.when(F.col("blk") == 0, F.concat(F.lit(TABLE_LINE + "\n"), "text"))
            .otherwise(F.col("text"))
            .alias("text"),
        )
    )


def flatten_layout(
    paragraphs: DataFrame, cells: DataFrame, reset_per_table: bool = False, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(doc_id, full_text)``: paragraphs, then the tables, one line per cell.

    The text of a document is one value here, so its paragraphs, the texts of
    its cells that leave some of them out, and the blocks of its tables go to
    one task at once, and no text of a paragraph moves again. ``layout_blocks``
    and ``chunk_blocks`` lead to the same chunks for documents that are too
    large to be one value.
    """
    left_out = F.coalesce(F.col("role"), F.lit("")).isin(*LEFT_OUT_ROLES)
    content = clean_layout_text(F.col("content"))
    block = F.floor(F.col("para_idx") / block_rows).cast("int")
    # A paragraph that is left out for its role still stands for its block, without its text.
    lines = paragraphs.select(
        "doc_id",
        F.lit(0).alias("section"),
        F.lit(-1).alias("table_idx"),
        block.alias("blk"),
        "para_idx",
        F.when(~left_out, content).alias("text"),
    )
    no_index = F.lit(None).cast(paragraphs.schema["para_idx"].dataType).alias("para_idx")
    no_number = F.lit(None).cast("int")
    cell_texts = cells.select("doc_id", F.lit(CELL_TEXT).alias("section"), no_number.alias("table_idx"), no_number.alias("blk"), no_index, content.alias("text"))
    tables = _table_blocks(cells, reset_per_table, block_rows).withColumn("para_idx", no_index)
    together = lines.unionByName(cell_texts).unionByName(tables).repartition("doc_id")
    # Rows of one text of a document, those of cells first; the text of a table is no paragraph.
    so_far = (
        Window.partitionBy("doc_id", "text")
        .orderBy("section")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    is_cell = F.col("section") == CELL_TEXT
    repeats = F.coalesce(F.first("section").over(so_far) == CELL_TEXT, F.lit(False)) & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    paragraph = F.col("section") == 0
    line = F.when(paragraph, F.when(~F.col("repeats"), F.concat("text", F.lit("\n")))).otherwise(F.col("text"))
    blocks = (
        together.withColumn("repeats", repeats)
        .where(~is_cell)
        .withColumn("line", line)
        .groupBy("doc_id", "section", "table_idx", "blk")
        .agg(_concatenated("para_idx", "line").alias("text"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("section", "table_idx", "blk", "text")))
    return blocks.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda block: block["text"]), "").alias("full_text")
    )
