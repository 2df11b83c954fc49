import random

import pytest

from folioseek.operators.layout import flatten_layout, kept_paragraphs, layout_blocks, with_headings

CELLS = "doc_id long, table_idx int, cell_idx int, row_index int, column_index int, kind string, content string"
PARAGRAPHS = "doc_id long, para_idx int, role string, content string"


def cell_frame(spark, rows):
    return spark.createDataFrame(rows, CELLS)


def test_text_of_one_document(spark):
    cells = cell_frame(
        spark,
        [
            (1, 0, 0, 0, 0, "columnHeader", "Name:selected:"),
            (1, 0, 1, 0, 1, "stubHead", "x"),
            (1, 0, 2, 1, 0, "content", " Ann\n"),
            (1, 0, 3, 1, 1, "content", "7"),
            (1, 1, 0, 0, 0, "content", "Bob"),
            (1, 1, 1, 1, 0, "columnHeader", ""),
            (1, 1, 2, 2, 0, "content", "Cid"),
        ],
    )
    paragraphs = spark.createDataFrame(
        [
            (1, 0, None, " Title :unselected:\n"),
            (1, 1, "pageNumber", "1"),
            (1, 2, "pageFooter", "end"),
            (1, 3, "title", "An\nn"),  # equals a cell once both are cleaned
            (1, 4, "sectionHeading", "Body\ntext"),
            (2, 0, "pageFooter", "only a footer"),
        ],
        PARAGRAPHS,
    )
    texts = {row["doc_id"]: row["full_text"] for row in flatten_layout(paragraphs, cells).collect()}
    assert texts == {
        1: "Title\n"
        "Bodytext\n"
        "Below is a Table:\n"
        "Cell[0][0] as columnHeader has text 'Name'\n"
        "Cell[0][1] as stubHead has text 'x'\n"
        "Cell[1][0] with column heading 'Name' has text ' Ann\n'\n"
        "Cell[1][1] has text '7'\n"
        "Below is a Table:\n"
        "Cell[0][0] with column heading 'Name' has text 'Bob'\n"
        "Cell[1][0] as columnHeader has text ''\n"
        "Cell[2][0] with column heading '' has text 'Cid'\n",
        2: "",
    }


def test_missing_role_is_kept(spark):
    paragraphs = spark.createDataFrame([(1, 0, None, "a"), (1, 1, "pageNumber", "b")], PARAGRAPHS)
    rows = kept_paragraphs(paragraphs, cell_frame(spark, [])).collect()
    assert [row["clean"] for row in rows] == ["a"]


def random_cells(seed):
    rng = random.Random(seed)
    rows = []
    for doc in range(3):
        for table in range(rng.randint(1, 4)):
            for at in range(rng.randint(1, 12)):
                kind = rng.choice(["columnHeader", "content", "content", "rowHeader"])
                rows.append((doc, table, at, at // 3, rng.randint(0, 2), kind, f"{doc}-{table}-{at}"))
    rng.shuffle(rows)
    return rows


def expected_headings(rows, reset):
    seen, result = {}, {}
    for doc, table, at, _, column, kind, content in sorted(rows):
        scope = (doc, table, column) if reset else (doc, column)
        if kind == "columnHeader":
            seen[scope] = content
        result[doc, table, at] = seen.get(scope)
    return result


@pytest.mark.parametrize("reset", [False, True])
@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_headings_do_not_depend_on_blocks(spark, reset, block_rows):
    rows = random_cells(block_rows)
    headed = with_headings(cell_frame(spark, rows), reset, block_rows).collect()
    found = {(r["doc_id"], r["table_idx"], r["cell_idx"]): r["heading"] for r in headed}
    assert found == expected_headings(rows, reset)


def test_text_does_not_depend_on_blocks(spark):
    cells = cell_frame(spark, random_cells(5))
    paragraphs = spark.createDataFrame([(d, i, None, f"p{d}.{i}") for d in range(3) for i in range(7)], PARAGRAPHS)
    assert sorted(flatten_layout(paragraphs, cells, block_rows=2).collect()) == sorted(
        flatten_layout(paragraphs, cells).collect()
    )


def test_one_document_with_most_cells_is_cut_into_blocks(spark):
    rows = [(1, 0, at, at, 0, "columnHeader" if at == 5 else "content", str(at)) for at in range(2000)]
    headed = with_headings(cell_frame(spark, rows), block_rows=64)
    assert {r["cell_idx"]: r["heading"] for r in headed.collect()} == {
        at: "5" if at >= 5 else None for at in range(2000)
    }
    plan = headed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "blk" in plan


def test_cell_texts_are_not_written_and_left_out_paragraphs_leave_a_block(spark, monkeypatch):
    monkeypatch.setattr("pyspark.sql.DataFrame.write", property(lambda self: pytest.fail("a table was written")))
    cells = cell_frame(spark, [(1, 0, 0, 0, 0, "content", "a"), (1, 0, 1, 1, 0, "content", "a")])
    rows = [(1, 0, None, "a"), (1, 1, None, "b"), (1, 2, None, None), (2, 0, "pageNumber", "b"), (None, 0, None, "n")]
    blocks = layout_blocks(spark.createDataFrame(rows, PARAGRAPHS), cells, block_rows=1).where("section = 0").collect()
    found = {(row["doc_id"], row["blk"], row["text"]) for row in blocks}
    assert found == {(1, 0, ""), (1, 1, "b\n"), (1, 2, ""), (2, 0, ""), (None, 0, "n\n")}


def test_only_headers_move_to_be_carried(spark):
    cells = cell_frame(spark, random_cells(2))
    plan = with_headings(cells, block_rows=2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1  # the cells themselves, once


@pytest.mark.parametrize("reset", [False, True])
def test_text_does_not_depend_on_how_rows_are_spread(spark, reset):
    rows = random_cells(3)
    lines = [(d, i, None, f"p{d}.{i}") for d in range(3) for i in range(7)]
    cells, paragraphs = cell_frame(spark, rows), spark.createDataFrame(lines, PARAGRAPHS)
    plain = sorted(flatten_layout(paragraphs, cells, reset, 2).collect())
    spread = flatten_layout(paragraphs.repartition(4, "doc_id"), cells.repartition(4, "doc_id"), reset, 2)
    assert sorted(spread.collect()) == plain
    headings = expected_headings(rows, reset)
    assert sum(text.count(f"with column heading '{heading}'") for _, text in plain for heading in set(headings.values())) == sum(
        1 for row in rows if row[5] == "content" and headings[row[0], row[1], row[2]] is not None
    )
