"""What ingest writes and moves: texts as few times as possible, compressed, and dropped when they are not read again."""

import re
from pathlib import Path

from pyarrow import parquet

from folioseek.operators import index
from folioseek.operators.layout import flatten_layout, layout_blocks
from folioseek.plans.ingest import ingest
from folioseek.sources import scratch
from workload import fixtures

PARAGRAPHS = "doc_id string, para_idx int, role string, content string"
CELLS = "doc_id string, table_idx int, cell_idx int, row_index int, column_index int, kind string, content string"

ODD_PARAGRAPHS = [
    ("a", 0, None, " first\n"),
    ("a", 1, "pageNumber", "left out"),
    ("a", 1, None, "same place"),
    ("a", 2, None, "in a cell :selected:"),
    ("a", 5, "title", "beyond a block"),
    ("a", 5, None, None),
    ("a", None, None, "no place"),
    ("b", 0, "pageFooter", "only left out"),
    (None, 0, None, "in a cell"),
    (None, 0, None, None),
    # A paragraph with the text of a printed table is no cell.
    ("d", 0, None, "Below is a Table:\nCell[0][0] has text 'x'\n"),
]
ODD_CELLS = [
    ("a", 0, 0, 0, 0, "columnHeader", "head"),
    ("a", 0, 3, 1, 0, "content", "in a cell"),
    ("a", 0, 3, 1, 0, "content", "again"),
    ("a", 1, 4, 0, 0, "content", "no first block"),
    ("a", None, 0, 0, 0, "content", None),
    ("b", 0, None, 0, 1, "content", "left out"),
    (None, 0, 0, 0, 0, "content", "in a cell"),
    ("c", 0, 0, 0, 0, "content", "only a cell"),
    ("d", 0, 0, 0, 0, "content", "x"),
]


def _rows(spark):
    return spark.createDataFrame(ODD_PARAGRAPHS, PARAGRAPHS), spark.createDataFrame(ODD_CELLS, CELLS)


def test_flattened_texts_are_the_blocks_in_order(spark):
    paragraphs, cells = _rows(spark)
    for block_rows in (2, 4096):
        blocks = layout_blocks(paragraphs, cells, block_rows=block_rows).collect()
        expected = {}
        for row in sorted(blocks, key=lambda r: (r.section, r.table_idx is not None, r.table_idx or 0, r.blk is not None, r.blk or 0)):
            expected[row.doc_id] = expected.get(row.doc_id, "") + (row.text or "")
        found = {row.doc_id: row.full_text for row in flatten_layout(paragraphs, cells, block_rows=block_rows).collect()}
        assert found == expected
        assert found["b"] == "Cell[0][1] has text 'left out'\n" and "in a cell" in found[None]


def test_texts_of_paragraphs_move_once(spark):
    plan = flatten_layout(*_rows(spark))._jdf.queryExecution().executedPlan().toString()
    keys = [re.findall(r"(\w+)#", found) for found in re.findall(r"Exchange hashpartitioning\((.*?)\)", plan)]
    assert keys.count(["doc_id"]) == 1
    assert not any({"clean", "text"} & set(names) or names == ["doc_id", "blk"] for names in keys)


def test_results_of_the_layout_service_are_dropped_once_the_corpus_is_saved(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda spark: str(tmp_path))
    files = spark.createDataFrame([("f", bytearray(b"one\ntwo")), ("g", bytearray(b""))], "source string, content binary")

    def analyze(content):
        lines = content.decode().split("\n")
        return {"paragraphs": [{"role": None, "content": line} for line in lines], "cells": []}

    table = f"{fixtures.fresh_database(spark)}.corpus"
    built = ingest(files, table, str(tmp_path / "index"), analyze=analyze)
    assert {row.text for row in built.chunks.collect()} == {"one two"}
    assert {row.full_text for row in spark.table(table).collect()} == {"one\ntwo\n", "\n"}
    assert not list(Path(tmp_path, "folioseek").glob("layouts-*"))


def test_packed_files_are_small_and_hold_any_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda spark: str(tmp_path))
    texts = ["", "100% %0C %25", "a:b\fc", "line\r\nline", "é \0", "many words " * 20000]
    rows = [*enumerate(texts), (1, "a second text"), (None, "no id"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = fixtures.document_files(spark, str(tmp_path)).collect()
    held = {}
    for doc_id, text in rows:
        held.setdefault(f"file-{'' if doc_id is None else doc_id}", []).append((text or "") + "\f")
    assert {row.source: bytes(row.content).decode() for row in found} == {name: "".join(sorted(parts)) for name, parts in held.items()}
    assert len(found) == len(held)
    written = [file for file in Path(tmp_path, "folioseek").glob("files-*/*") if file.suffix != ".crc"]
    assert sum(file.stat().st_size for file in written) < 20000


def test_rising_lists_of_postings_are_written_by_their_steps(spark, tmp_path):
    corpus = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "'s' AS source", "concat('w', id % 900, ' v', id % 7) AS full_text")
    index.build_index(corpus, str(tmp_path / "index"))
    file = next((tmp_path / "index" / "segments").glob("*/postings/*.parquet"))
    group = parquet.ParquetFile(file).metadata.row_group(0)
    encodings = {column.path_in_schema.split(".")[0]: column.encodings for column in map(group.column, range(group.num_columns))}
    assert all(encodings[name] == ("DELTA_BINARY_PACKED",) for name in ("bucket", "ends"))
    chunks = next((tmp_path / "index" / "segments").glob("*/chunks/*.parquet"))
    assert parquet.ParquetFile(chunks).metadata.row_group(0).column(0).compression == "ZSTD"
