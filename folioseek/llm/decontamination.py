"""Benchmark decontamination: a BM25 index of test items, searched with every passage of the training texts.

The words of an item are cut into segments of at most ``STRIDE`` words, the
rows of an inverted index. Postings hold the BM25 weight of a word in a
segment as a share of the segment's score for its own words, so that 1 is a
verbatim copy and one threshold serves items of any length. Four segments are
a block, which knows the greatest weight of each word in it.

Passages are windows of two strides, one stride apart, so any run of
``STRIDE`` words lies in one of them whole. Each passage is a query. Block-max
WAND, over all passages of a batch at once: the greatest weights of a
passage's distinct words are added up block by block, from lists of blocks or,
for words that stand in many, from a matrix; only passages and blocks whose
bound reaches the threshold are scored segment by segment. The bound never
lies under the score, so every segment at or above ``MIN_SCORE`` is found.

What is found is verified against the whole text: an item leaks if at least
``MIN_OVERLAP`` of the words of its question, and of its answer, stand in runs
of ``RUN`` words that the text holds as well. A question or an answer of fewer
words is one run, looked for in the passages that were found and one stride
before and behind them. An item without an answer column
is split before its last sentence; of one sentence, it is all question.

The index is sent to the tasks in blocks of about ``MAX_BLOCK_WORDS`` words of
items, measured first; more items are searched block by block, and no item or
passage is left out. The only thing that one item has to fit into is a task.

A null or empty text has no passage and leaks nothing. Items without words are
never found. Repeated items are found under each of their ids, repeated ids
once. Columns that are kept pass through; ``leaks`` replaces one of its name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from folioseek.llm.common import Tokens, byte_class, slices, tokens

WORD = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)))
STRIDE = 32
BLOCK = 4
K1, B = 1.2, 0.75
MIN_SCORE = 0.4
MIN_OVERLAP = 0.8
RUN = 3
COMMON = 0.25
MAX_BLOCK_WORDS = 1_000_000
CELLS = 4_000_000


def parted(benchmark: DataFrame) -> DataFrame:
    """``item_id, question, answer`` from items of one text: the last sentence is the answer."""
    text = F.coalesce("text", F.lit(""))
    cut = r"(?s)^(.*[.?!\n])\s+(\S.*?)\s*$"
    two = F.regexp_like(text, F.lit(cut))
    return benchmark.select(
        "item_id",
        F.when(two, F.regexp_extract(text, cut, 1)).otherwise(text).alias("question"),
        F.when(two, F.regexp_extract(text, cut, 2)).otherwise("").alias("answer"),
    )


def item_blocks(items: DataFrame, max_words: int = MAX_BLOCK_WORDS) -> Iterator[list[tuple]]:
    """The items ``(item_id, question, answer)`` in blocks that the driver and every task can hold."""
    chars = items.agg(F.sum(F.octet_length(F.concat_ws(" ", "question", "answer")))).first()[0] or 0
    blocks = max(1, -(-chars // (6 * max_words)))
    place = F.pmod(F.xxhash64("question", "answer"), F.lit(blocks))
    for block in range(blocks):
        rows = items.where(place == block).orderBy("item_id", "question", "answer").collect()
        yield [(row["item_id"], row["question"] or "", row["answer"] or "") for row in rows]


@dataclass
class Item:
    item_id: object
    question: np.ndarray
    answer: np.ndarray

    @property
    def short(self) -> bool:
        """Whether the question or the answer has words, but fewer than a run."""
        return 0 < len(self.question) < RUN or 0 < len(self.answer) < RUN


class Postings:
    """Weights of words in columns (blocks or segments): lists by word, and a matrix for the few words of many columns."""

    def __init__(self, rows: list[tuple[int, int, float]], size: int, columns: int, common: np.ndarray | None = None):
        rows = sorted(rows)
        words = np.array([word for word, *_ in rows], dtype=np.int64)
        self.column = np.array([column for _, column, _ in rows], dtype=np.int64)
        self.weight = np.array([weight for *_, weight in rows])
        self.columns = columns
        self.first = np.searchsorted(words, np.arange(size + 1))
        # A small index walks the lists of all words.
        self.common = np.diff(self.first) > max(16, COMMON * columns) if common is None else common
        self.place = np.cumsum(self.common) - 1
        self.matrix = np.zeros((int(self.common.sum()), columns))
        dense = self.common[words]
        self.matrix[self.place[words[dense]], self.column[dense]] = self.weight[dense]

    def sums(self, row: np.ndarray, word: np.ndarray, rows: int) -> np.ndarray:
        """For each row the sums of the weights of its distinct words, by column."""
        dense = self.common[word]
        present = np.zeros((rows, len(self.matrix)))
        present[row[dense], self.place[word[dense]]] = 1.0
        row, word = row[~dense], word[~dense]
        begin = self.first[word]
        count = self.first[word + 1] - begin
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) - np.repeat(ends - count, count) + np.repeat(begin, count)
        cell = np.repeat(row, count) * self.columns + self.column[place]
        return present @ self.matrix + np.bincount(cell, self.weight[place], rows * self.columns).reshape(rows, self.columns)


class ItemIndex:
    """The inverted index of a block of items."""

    def __init__(self, rows: Sequence[tuple]):
        found = tokens(pa.array([part for _, *parts in rows for part in parts], pa.string()), WORD)
        self.words = found.distinct
        self.items = [Item(row[0], found.of(2 * i), found.of(2 * i + 1)) for i, row in enumerate(rows)]
        segments, self.item_of = [], []
        for number, item in enumerate(self.items):
            both = np.concatenate([item.question, item.answer])
            if len(both):
                for piece in np.array_split(both, -(-len(both) // STRIDE)):
                    segments.append(np.unique(piece, return_counts=True))
                    self.item_of.append(number)
        self._weigh(segments)

    def ids(self, found: Tokens) -> np.ndarray:
        """The word of the index for each distinct word of some texts, -1 for none."""
        place = pc.index_in(found.distinct, value_set=self.words)
        return place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def _weigh(self, segments: list[tuple[np.ndarray, np.ndarray]]) -> None:
        size = len(self.words)
        self.blocks = -(-len(segments) // BLOCK)
        df = np.zeros(size)
        for words, _ in segments:
            df[words] += 1
        idf = np.log(1 + (len(segments) - df + 0.5) / (df + 0.5))
        lengths = np.array([counts.sum() for _, counts in segments] or [1])
        self.segments = []
        tops: dict[tuple[int, int], float] = {}
        for number, (words, counts) in enumerate(segments):
            norm = K1 * (1 - B + B * lengths[number] / lengths.mean())
            weights = idf[words] * counts * (K1 + 1) / (counts + norm)
            weights = weights / weights.sum()
            self.segments.append((words, weights))
            for word, weight in zip(words.tolist(), weights.tolist(), strict=True):
                key = (word, number // BLOCK)
                tops[key] = max(tops.get(key, 0.0), weight)
        self.in_blocks = Postings([(word, block, weight) for (word, block), weight in tops.items()], size, self.blocks)
        rows = [(w, number, x) for number, (words, weights) in enumerate(self.segments) for w, x in zip(words.tolist(), weights.tolist(), strict=True)]
        self.in_segments = Postings(rows, size, len(segments), common=self.in_blocks.common)
        self.block_of = np.arange(len(segments)) // BLOCK
        self.item_of = np.array(self.item_of, dtype=np.int64)

    def above(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """``(text, first word, segment, score)`` of all passages and segments at or above the threshold, as arrays.

        ``ids`` are the words of all texts, -1 if in no item; text ``i`` has ``starts[i]`` to ``starts[i + 1]``.
        """
        counts = -(-np.diff(starts) // STRIDE)
        first = np.concatenate([[0], np.cumsum(counts)])
        text_of = np.repeat(np.arange(len(counts)), counts)
        places = np.flatnonzero(ids >= 0)
        text = np.searchsorted(starts, places, side="right") - 1
        stride = first[text] + (places - starts[text]) // STRIDE
        # A passage is a stride and the next one of its text; each of its words counts once.
        size = len(self.words)
        own = stride * size + ids[places]
        keys = np.unique(np.concatenate([own, own[stride > first[text]] - size]))
        passage, word = keys // size, keys % size
        step = max(1, CELLS // max(1, len(self.segments)))
        for low in range(0, len(text_of), step):
            high = min(low + step, len(text_of))
            here = slice(*np.searchsorted(passage, [low, high]))
            rows, words = passage[here] - low, word[here]
            bounds = self.in_blocks.sums(rows, words, high - low) >= MIN_SCORE - 1e-9
            reached = np.flatnonzero(bounds.any(axis=1))
            if not len(reached):
                continue
            again = np.isin(rows, reached)
            place = np.searchsorted(reached, rows[again])
            scores = self.in_segments.sums(place, words[again], len(reached))
            wanted = (scores >= MIN_SCORE - 1e-9) & bounds[reached][:, self.block_of]
            row, segment = np.nonzero(wanted)
            at = low + reached[row]
            yield text_of[at], starts[text_of[at]] + (at - first[text_of[at]]) * STRIDE, segment, scores[row, segment]

    def search(self, ids: np.ndarray, starts: np.ndarray) -> dict[int, list[tuple]]:
        """For each text with leaks their ``(item_id, score, question_overlap, answer_overlap)``."""
        if not self.segments:
            return {}
        found: dict[tuple[int, int], float] = {}
        near: dict[tuple[int, int], set[int]] = {}
        for texts, begins, segments, scores in self.above(ids, starts):
            for text, begin, item, score in zip(texts.tolist(), begins.tolist(), self.item_of[segments].tolist(), scores.tolist(), strict=True):
                found[text, item] = max(score, found.get((text, item), 0.0))
                if self.items[item].short:
                    near.setdefault((text, item), set()).add(begin)
        leaks: dict[int, dict] = {}
        held: tuple[int, np.ndarray] | None = None
        for (text, number), score in sorted(found.items()):
            if held is None or held[0] != text:
                held = (text, np.unique(runs(ids[starts[text] : starts[text + 1]], len(self.words))))
            item = self.items[number]
            both = np.concatenate([item.question, item.answer])
            covered = covered_words(both, held[1], len(self.words))
            asked, answered = covered[: len(item.question)], covered[len(item.question) :]
            for part, own in ((item.question, asked), (item.answer, answered)):
                if 0 < len(part) < RUN and not own.all():
                    own[:] |= any(
                        holds(ids[max(starts[text], begin - STRIDE) : min(starts[text + 1], begin + 3 * STRIDE)], part) for begin in near[text, number]
                    )
            asked, answered = share(asked), share(answered)
            if asked >= MIN_OVERLAP and answered >= MIN_OVERLAP:
                own = leaks.setdefault(text, {})
                own[item.item_id] = max(own.get(item.item_id, (0.0,)), (score, asked, answered))
        return {text: [(item, *numbers) for item, numbers in own.items()] for text, own in leaks.items()}


def runs(ids: np.ndarray, size: int, length: int = RUN) -> np.ndarray:
    """A number for each run of ``length`` words; runs with an unknown word are -1."""
    if len(ids) < length:
        return np.zeros(0, np.int64)
    total = np.zeros(len(ids) - length + 1, dtype=np.int64)
    known = np.ones(len(total), dtype=bool)
    for place in range(length):
        part = ids[place : len(ids) - length + 1 + place]
        total = total * (size + 1) + part
        known &= part >= 0
    return np.where(known, total, -1)


def covered_words(item: np.ndarray, present: np.ndarray, size: int) -> np.ndarray:
    """Which words of an item stand in a run that a text holds."""
    length = min(RUN, len(item))
    covered = np.zeros(len(item), dtype=bool)
    if length < RUN:
        return covered
    for at in np.flatnonzero(np.isin(runs(item, size), present)):
        covered[at : at + length] = True
    return covered


def holds(words: np.ndarray, part: np.ndarray) -> bool:
    """Whether some words hold a part as one run."""
    if len(words) < len(part):
        return False
    same = np.ones(len(words) - len(part) + 1, dtype=bool)
    for place, word in enumerate(part):
        same &= words[place : place + len(same)] == word
    return bool(same.any())


def share(covered: np.ndarray) -> float:
    return float(covered.mean()) if len(covered) else 1.0


def leak_type(item_type: T.DataType) -> T.ArrayType:
    numbers = [T.StructField(name, T.DoubleType()) for name in ("score", "question_overlap", "answer_overlap")]
    return T.ArrayType(T.StructType([T.StructField("item_id", item_type), *numbers]))


def _searcher(rows: list[tuple], keep: list[str], item_type: pa.DataType):
    kind = pa.list_(
        pa.struct([("item_id", item_type), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(rows)
        for batch in slices(batches):
            found = tokens(batch.column("text"), WORD)
            leaks = index.search(index.ids(found)[found.codes], found.starts)
            names = ("item_id", "score", "question_overlap", "answer_overlap")
            values = [[dict(zip(names, leak, strict=True)) for leak in leaks.get(i, [])] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(values, kind)], [*keep, "leaks"])

    return search


def searched(documents: DataFrame, items: DataFrame, keep: Sequence[str] | None = None, max_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """The columns ``keep`` of the documents (all without it) and their ``leaks``.

    ``items`` has ``item_id, question, answer``. Each block of items is one
    more step over the documents in the same tasks, without a shuffle.
    """
    wanted = [c for c in (keep if keep is not None else documents.columns) if c != "leaks"]
    carried = [*wanted, *(["text"] if "text" not in wanted else [])]
    item_type = items.schema["item_id"].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_type.simpleString()]
    rows = documents.select(*carried).withColumn("leaks so far", F.array().cast(leak_type(item_type)))
    blocks = list(item_blocks(items, max_words))
    for place, block in enumerate(blocks):
        last = place == len(blocks) - 1
        kept = [c for c in rows.columns if c != "text" or not last or "text" in wanted]
        schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("leaks", leak_type(item_type))])
        rows = rows.mapInArrow(_searcher(block, kept, arrow), schema)
        rows = rows.withColumn("leaks so far", F.concat("leaks so far", "leaks")).drop("leaks")
    return rows.select(*wanted, F.col("leaks so far").alias("leaks"))


def clean() -> Column:
    return F.size("leaks") == 0
