"""The k best chunks of an index for each question, exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioseek.sources.scratch import fresh_path, written
from folioseek.sources.session import small_batches

# Bounds of one block of questions. Vectors of a block are sent to all
# executors and its hits are broadcast to fetch texts, so both are limited:
# 8 million vector cells (under 200 MB) and 400,000 hits (under 30 MB).
MAX_BLOCK_CELLS = 8_000_000
MAX_BLOCK_HITS = 400_000

# Each task of a search hands on k rows per question, so file splits are read
# several in one task: as many tasks per core, or as many splits per task,
# whichever makes more tasks.
TASKS_PER_CORE = 8
SPLITS_PER_TASK = 64


# Scores that wait to be merged with the best rows.
WAITING_ROWS = 2048


class BestRows:
    """The k best rows per question seen so far in one task."""

    def __init__(self, num_questions: int, k: int, floor: float) -> None:
        self.k = k
        self.floor = floor
        self.bar = np.full(num_questions, floor)
        self.question = np.empty(0, np.int64)
        self.score = np.empty(0, np.float64)
        self.ids: list[np.ndarray] | None = None
        self.waiting: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        self.num_waiting = 0

    def add(self, scores: np.ndarray, ids: list[np.ndarray]) -> None:
        """Merge a ``rows x questions`` tile; smaller ids win equal scores."""
        worthy = (scores >= self.bar) & (scores > self.floor)
        if len(scores) > self.k and np.count_nonzero(worthy) > 4 * self.k * len(self.bar):
            # Only what is as good as the k-th of this tile can stay.
            worthy &= scores >= np.partition(scores, -self.k, axis=0)[-self.k]
        row, question = np.nonzero(worthy)
        if len(row) == 0:
            return
        self._merge(question, scores[row, question], [column[row] for column in ids])

    def add_cells(self, question: np.ndarray, scores: np.ndarray, ids: list[np.ndarray]) -> None:
        """Take in single scores with the question and the ids of each; ``flush`` merges the last of them."""
        worthy = np.flatnonzero((scores >= self.bar[question]) & (scores > self.floor))
        if len(worthy):
            self.waiting.append((question[worthy], scores[worthy], [column[worthy] for column in ids]))
            self.num_waiting += len(worthy)
        # Merging sorts all that is kept, so it waits until there is something to merge.
        enough = min(WAITING_ROWS, 2 * self.k * len(self.bar))
        if self.num_waiting > max(enough, len(self.question) // 2):
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            questions, scores, ids = zip(*self.waiting)
            self.waiting, self.num_waiting = [], 0
            self._merge(np.concatenate(questions), np.concatenate(scores), [np.concatenate(column) for column in zip(*ids)])

    def _merge(self, question: np.ndarray, scores: np.ndarray, new_ids: list[np.ndarray]) -> None:
        self.ids = new_ids if self.ids is None else [np.concatenate(p) for p in zip(self.ids, new_ids)]
        self.question = np.concatenate([self.question, question])
        self.score = np.concatenate([self.score, scores])
        order = np.lexsort((*reversed(self.ids), -self.score, self.question))
        sorted_question = self.question[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_question, sorted_question)
        kept = order[place < self.k]
        self.question, self.score = self.question[kept], self.score[kept]
        self.ids = [column[kept] for column in self.ids]
        full = np.flatnonzero(place == self.k - 1)
        self.bar[sorted_question[full]] = self.score[np.flatnonzero(place[place < self.k] == self.k - 1)]


ARROW_TYPES = {
    "tinyint": pa.int8(),
    "smallint": pa.int16(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "string": pa.string(),
    "date": pa.date32(),
}


def _id_array(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def scan(column: str, ids: Sequence[str], k: int):
    """Search rows by the scores of all of them."""

    def find(batches: Iterator[pa.RecordBatch], scorer) -> BestRows:
        kept = BestRows(scorer.num_questions, k, scorer.floor())
        for batch in batches:
            id_columns = [_id_array(batch.column(name)) for name in ids]
            for top, scores in scorer.tiles(batch.column(column)):
                kept.add(scores, [values[top : top + len(scores)] for values in id_columns])
        return kept

    return find


def _search_block(stored: DataFrame, find, id_types: dict[str, str], question_ids: list, question_type: str, scorer, k: int, batch_rows: int | None = None) -> DataFrame:
    """``(question_id, score, *ids, rank)``: k best rows per question, found once and written."""
    spark = stored.sparkSession
    shared = spark.sparkContext.broadcast((scorer, question_ids))
    types = {"question_id": question_type, "score": "double"} | id_types

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, question_ids = shared.value
        kept = find(batches, scorer)
        if len(kept.question):
            columns = {
                "question_id": pa.array([question_ids[q] for q in kept.question], ARROW_TYPES[question_type]),
                "score": pa.array(kept.score),
            }
            for name, values in zip(id_types, kept.ids):
                columns[name] = pa.array(values.tolist(), ARROW_TYPES[types[name]])
            yield pa.RecordBatch.from_pydict(columns)

    schema = ", ".join(f"{name} {kind}" for name, kind in types.items())
    splits = stored.rdd.getNumPartitions()
    tasks = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-splits // SPLITS_PER_TASK))
    found = stored.coalesce(tasks).mapInArrow(best, schema)
    # The window sees k rows per task and question, not one per chunk.
    ranked = Window.partitionBy("question_id").orderBy(F.desc("score"), *[F.asc(name) for name in id_types])
    best_found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    with small_batches(spark, batch_rows):
        hits = written(best_found, "hits")
    shared.destroy()
    return hits.where(F.col("rank") <= k)


def _block_count(question_vectors: DataFrame, cells: Column, k: int) -> int:
    """Into how many hash blocks the questions go so that each one is bounded."""
    blocks = 1
    while True:
        block = F.pmod(F.xxhash64("question_id"), F.lit(blocks))
        sizes = question_vectors.groupBy(block.alias("block")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(cells.cast("long")).alias("cells")
        )
        largest = sizes.agg(F.max("n").alias("n"), F.max("cells").alias("cells")).first()
        if largest["n"] is None:
            return 0
        excess = max(largest["n"] * k / MAX_BLOCK_HITS, largest["cells"] / MAX_BLOCK_CELLS)
        # A block of one question cannot be split further.
        if excess <= 1 or largest["n"] == 1:
            return blocks
        blocks *= max(2, math.ceil(1.25 * excess))


def nearest(
    question_vectors: DataFrame,
    vectors: DataFrame,
    embedder,
    ids: Sequence[str],
    k: int,
    prepared=None,
    attach=lambda hits: hits,
    walk=None,
    batch_rows: int | None = None,
) -> DataFrame:
    """Exact k nearest rows of ``vectors`` for each ``(question_id, vector)``.

    The search runs when this is called; what it returns reads its results.
    Question ids that repeat or are null are refused. The stored vectors are never shuffled. Questions go to the executors in
    blocks of bounded size; each task keeps its own k best rows. The hits of a
    block are written to the shared folder, so that the search runs once
    whatever is done with them, and ``attach`` may broadcast them. With more
    questions than one block holds, each block is completed by ``attach`` and
    written before the next one: neither the driver nor an executor ever holds
    more than one block. ``walk`` searches rows of another form than ``vectors``
    and says of which: ``(rows, find, types of ids)``; ``batch_rows`` of them go to Python at a time.
    """
    question_type = question_vectors.schema["question_id"].dataType.simpleString()
    column = embedder.column
    # Blocks are counted and then read one by one; vectors are made once.
    questions = written(question_vectors.select("question_id", column), "questions")
    if walk is None:
        walk = vectors.select(column, *ids), scan(column, ids, k), {name: vectors.schema[name].dataType.simpleString() for name in ids}
    stored, find, id_types = walk
    counted = questions.agg(F.count("question_id").alias("ids"), F.count_distinct("question_id").alias("distinct"), F.count("*").alias("rows"))
    ids_found = counted.first()
    if len(set(ids_found)) > 1:
        raise ValueError("question_id has to be unique and not null")
    blocks = _block_count(questions, embedder.cells(), k)

    def search(block: int) -> DataFrame:
        block_of = F.pmod(F.xxhash64("question_id"), F.lit(max(blocks, 1)))
        part = questions.where(block_of == block) if blocks > 1 else questions
        rows = part.collect() if blocks else []  # bounded: see MAX_BLOCK_CELLS
        scorer = embedder.scorer([row[column] for row in rows], prepared)
        asked = [row["question_id"] for row in rows]
        return attach(_search_block(stored, find, id_types, asked, question_type, scorer, k, batch_rows))

    if blocks <= 1:
        return search(0)
    path = fresh_path(question_vectors.sparkSession, "search")
    for block in range(blocks):
        complete = search(block)
        complete.write.parquet(f"{path}/block={block}")
    return question_vectors.sparkSession.read.schema(complete.schema).parquet(f"{path}/block=*")
