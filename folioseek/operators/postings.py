"""Inverted blocks of chunks, searched block by block as far as their bounds allow.

A block holds ``BLOCK_CHUNKS`` chunks that follow each other in a segment of the
index: their ids, and for each bucket found in them the chunks that have it,
with term frequencies. Beside each bucket stands the largest share it has in a
chunk of the block: its frequency over the length of the chunk's vector. The
sum of what a question's buckets can add at most is a bound on the cosine of
all chunks of the block; where it stays below the k-th best score that a task
has found so far, the block is skipped for that question.

Shares are computed with the weights of the index when the segment is written.
Weights change as segments are added, and each segment keeps a factor by which
its bounds are widened, so that they hold at all later weights. Scores are
always computed anew from frequencies and present weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioseek.operators.embedders import SparseScorer, term_runs
from folioseek.operators.retrieval import ARROW_TYPES, BestRows

# Chunks of a block, at most 128.
BLOCK_CHUNKS = 64

# Entries of posting lists, pairs of a bucket and a question, and of a chunk and a question, that are worked on at a time.
STEP_CELLS = 1 << 16

# Blocks that are decoded and go to a search at a time: a row holds about 10,000 entries, of which a batch of the usual
# 10,000 rows or 64 MB stands in the JVM and in the worker at once, and a scan in arrays that double until they hold a batch.
BATCH_BLOCKS = 8

# Above rounding errors of sums and of shares stored with 32 bits.
SAFE = 1 + 1e-6


def postings_schema(id_types: Mapping[str, str]) -> str:
    ids = ", ".join(f"{name} array<{kind}>" for name, kind in id_types.items())
    return f"{ids}, bucket array<int>, ends array<int>, chunk array<tinyint>, tf array<int>, share array<float>"


def make_postings(chunks: DataFrame, column: str, ids: Sequence[str], squared_weights: np.ndarray, block: int = BLOCK_CHUNKS) -> DataFrame:
    """A row for each block of ``chunks``, which are read in the order of their files."""
    types = {name: chunks.schema[name].dataType.simpleString() for name in ids}
    shared = chunks.sparkSession.sparkContext.broadcast(squared_weights)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for top in range(0, batch.num_rows, block):
                yield inverted(batch.slice(top, block), column, types, weights)

    return chunks.select(column, *ids).mapInArrow(invert, postings_schema(types))


def inverted(rows: pa.RecordBatch, column: str, id_types: Mapping[str, str], squared_weights: np.ndarray) -> pa.RecordBatch:
    vectors = rows.column(column)
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
    chunk, bucket, tf = term_runs(flat, np.diff(offsets))
    norms = np.sqrt(np.bincount(chunk, weights=tf * tf * squared_weights[bucket], minlength=len(rows)))
    order = np.lexsort((chunk, bucket))
    chunk, bucket, tf = chunk[order], bucket[order], tf[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    share = np.maximum.reduceat(tf / norms[chunk], starts) if len(starts) else np.zeros(0)
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
    columns = [one(rows.column(name), ARROW_TYPES[kind]) for name, kind in id_types.items()]
    ends = np.append(starts, len(bucket))[1:] if len(starts) else starts
    columns += [one(bucket[starts], pa.int32()), one(ends, pa.int32()), one(chunk, pa.int8()), one(tf, pa.int32())]
    return pa.RecordBatch.from_arrays([*columns, one(share.astype(np.float32), pa.float32())], [*id_types, "bucket", "ends", "chunk", "tf", "share"])


class _Lists:
    """A list column as one flat array, and where the list of each row ends."""

    def __init__(self, column: pa.ListArray) -> None:
        offsets = column.offsets.to_numpy().astype(np.int64)
        self.flat = column.values.slice(offsets[0], offsets[-1] - offsets[0])
        self.bounds = offsets - offsets[0]
        self.sizes = np.diff(self.bounds)

    def numbers(self, kind=np.int64) -> np.ndarray:
        return self.flat.to_numpy(zero_copy_only=False).astype(kind)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of each run, one run after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class BlockSearch:
    """The k best chunks of each question in the blocks of one task, with counts of the work done.

    ``bounded`` counts pairs of a block and a question with a bucket in common,
    ``skipped`` those that their bound ruled out, ``scored`` the pairs of a
    chunk and a question whose score was computed.
    """

    def __init__(self, scorer: SparseScorer, k: int, slack: Mapping[int, float]) -> None:
        self.scorer, self.slack = scorer, slack
        self.best = BestRows(scorer.num_questions, k, scorer.floor())
        self.lengths = np.sqrt(scorer.norms)
        self.bounded = self.skipped = self.scored = 0

    def add(self, blocks: pa.RecordBatch, ids: Sequence[str]) -> None:
        """Search blocks, as many at a time as have ``STEP_CELLS`` entries, or pairs of a bucket and a question."""
        buckets = _Lists(blocks.column("bucket"))
        bucket = buckets.numbers()
        asked = np.append(0, np.cumsum(self.scorer.first[bucket + 1] - self.scorer.first[bucket]))[buckets.bounds]
        entries = _Lists(blocks.column("chunk")).bounds
        top = 0
        while top < len(blocks):
            ends = [int(np.searchsorted(sums, sums[top] + STEP_CELLS, side="right")) - 1 for sums in (asked, entries)]
            end = max(top + 1, min(ends))
            if asked[end] > asked[top]:
                self._add(blocks.slice(top, end - top), ids)
            top = end

    def _add(self, blocks: pa.RecordBatch, ids: Sequence[str]) -> None:
        scorer = self.scorer
        buckets = _Lists(blocks.column("bucket"))
        bucket = buckets.numbers()
        block = np.repeat(np.arange(len(blocks)), buckets.sizes)
        asked = scorer.first[bucket + 1] - scorer.first[bucket]
        hit = np.flatnonzero(asked)
        widened = np.array([self.slack.get(segment, 1.0) for segment in blocks.column("segment").to_pylist()]) * SAFE
        share = _Lists(blocks.column("share")).numbers(np.float64)
        # What each question can get from each bucket of each block, summed by block and question.
        posting = _spread(scorer.first[bucket[hit]], asked[hit])
        owner, count = scorer.owner[posting], asked[hit]
        pair, place = np.unique(np.repeat(block[hit], count) * scorer.num_questions + owner, return_inverse=True)
        bounds = np.bincount(place, weights=np.repeat(share[hit], count) * scorer.worth[posting])
        of_block, question = np.divmod(pair, scorer.num_questions)
        bounds *= widened[of_block] / np.maximum(self.lengths[question], 1e-300)
        self.bounded += len(pair)
        # Promising blocks first, so that the others meet a higher bar.
        highest = np.zeros(len(blocks))
        np.maximum.at(highest, of_block, bounds)
        data = _Blocks(blocks, buckets, ids, scorer.squared_weights)
        first = np.searchsorted(of_block, np.arange(len(blocks) + 1))
        entry = np.repeat(np.arange(len(hit)), count)
        by_pair = np.argsort(place, kind="stable")
        pair_first = np.searchsorted(place[by_pair], np.arange(len(pair) + 1))
        for number in np.argsort(-highest, kind="stable"):
            pairs = np.arange(first[number], first[number + 1])
            alive = pairs[bounds[pairs] >= self.best.bar[question[pairs]]]
            self.skipped += len(pairs) - len(alive)
            if not len(alive):
                continue
            own = by_pair[_spread(pair_first[alive], np.diff(pair_first)[alive])]
            which = np.repeat(np.arange(len(alive)), np.diff(pair_first)[alive])
            self._score(data, number, question[alive], which, hit[entry[own]], scorer.worth[posting[own]])

    def _score(self, data: _Blocks, number: int, question: np.ndarray, which: np.ndarray, place: np.ndarray, worth: np.ndarray) -> None:
        """Score the chunks of a block against ``question``; each posting list at ``place`` is worth ``worth`` to question ``which``."""
        size = data.sizes[number]
        norms = data.norms(number)
        # Each question takes up its cells and the entries of its lists.
        taken = size + np.bincount(which, weights=data.ends[place] - data.starts[place], minlength=len(question))
        passes = np.cumsum(taken) // STEP_CELLS
        lows = np.flatnonzero(np.diff(passes, prepend=-1))
        for low, high in zip(lows, np.append(lows[1:], len(question))):
            first, last = np.searchsorted(which, (low, high))
            chosen, value, target = place[first:last], worth[first:last], which[first:last] - low
            starts, counts = data.starts[chosen], data.ends[chosen] - data.starts[chosen]
            entries = _spread(starts, counts)
            cell = np.repeat(target, counts) * size + data.chunk[entries]
            dots = np.bincount(cell, weights=data.tf[entries] * np.repeat(value, counts), minlength=0)
            cells = np.flatnonzero(dots)
            part, chunk = np.divmod(cells, size)
            asked = question[low + part]
            self.scored += len(cells)
            scores = dots[cells] / np.sqrt(norms[chunk] * self.scorer.norms[asked])
            self.best.add_cells(asked, scores, data.ids(number, chunk))


class _Blocks:
    """Flat arrays of the blocks of a batch."""

    def __init__(self, blocks: pa.RecordBatch, buckets: _Lists, ids: Sequence[str], squared_weights: np.ndarray) -> None:
        chunk = _Lists(blocks.column("chunk"))
        self.chunk, self.tf = chunk.numbers(), _Lists(blocks.column("tf")).numbers()
        self.entry_bounds = chunk.bounds
        local = _Lists(blocks.column("ends")).numbers()
        self.ends = local + np.repeat(chunk.bounds[:-1], buckets.sizes)
        self.starts = np.append(0, self.ends[:-1]) if len(self.ends) else self.ends
        # A list starts where the one before it ends, and blocks follow each other without a gap.
        self.weights = np.repeat(squared_weights[buckets.numbers()], self.ends - self.starts)
        self.id_columns = [blocks.column(name) if name == "segment" else _Lists(blocks.column(name)) for name in ids]
        self.sizes = _Lists(blocks.column("row")).sizes

    def norms(self, number: int) -> np.ndarray:
        low, high = self.entry_bounds[number], self.entry_bounds[number + 1]
        tf = self.tf[low:high]
        return np.bincount(self.chunk[low:high], weights=tf * tf * self.weights[low:high], minlength=self.sizes[number])

    def ids(self, number: int, chunk: np.ndarray) -> list[np.ndarray]:
        found = []
        for column in self.id_columns:
            if isinstance(column, _Lists):
                values = column.flat.take(pa.array(column.bounds[number] + chunk)).to_numpy(zero_copy_only=False)
                found.append(values.astype(str) if values.dtype == object else values)
            else:
                found.append(np.full(len(chunk), column[number].as_py()))
        return found


def walk(ids: Sequence[str], k: int, slack: Mapping[int, float]):
    """Search blocks of postings, as ``retrieval.nearest`` asks for it."""

    def find(batches: Iterator[pa.RecordBatch], scorer: SparseScorer) -> BestRows:
        search = BlockSearch(scorer, k, slack)
        for batch in batches:
            search.add(batch, ids)
        search.best.flush()
        return search.best

    return find
