"""Language-model scores from an n-gram trie learned from the corpus.

Levels are counted one after the other over all training documents. Tasks sum
n-grams in compact sorted blocks, which are dealt by ranges of n-grams, so that
a frequent word or context is many small sums and lies in as many parts as it
fills; blocks of one part are added up in one task, which also writes that part
of the level, so that counts are shuffled once and never stand as rows. Ranges
of words are even, as their hashes are; those of longer n-grams come from the
n-grams of a sample of texts (``SAMPLE_BYTES``), which decides where
parts end and nothing else. The number of parts follows the number of tokens.
Above the single words, n-grams seen less than ``min_count`` times are left to
the lower level, and only n-grams whose shorter n-grams were kept are counted,
which loses none that is seen so often. The counts become the trie of ``trie.py``, level by level.

The probability of a token after a context is its discounted share of the
context's count plus the context's back-off weight times the probability after
the context without its first word; below two words it is
``(c + 1) / (N + V + 1)``. A text is scored in one pass: words, then one end;
contexts do not reach over the begin of a text, which is a context of its own.

A null or empty text is one end. Words are told apart by 63 bits of their
hash. A document without ``doc_id`` is trained on. Rows that repeat are scored
and counted as often as they stand there. Columns other than ``doc_id`` and
``text`` are not read. Without training documents every probability is
``1 / (N + V + 1) = 1``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from folioseek.llm.common import grouped, slices, tokens
from folioseek.llm.trie import SHARD_SCHEMA, Level, ShardRow, build_entries, build_words, shard_batch
from folioseek.sources.scratch import fresh_path, written

ORDER = 3
MIN_COUNT = 2
DISCOUNT = 0.5
# The hash of the end of a text.
END = 1
FLUSH_ENTRIES = 1 << 20
# Text that is looked up at a time: the more there is, the more n-grams of a shard come together, and the more of them repeat.
LOOKUP_BYTES = 1 << 22
PART_TOKENS = 2_000_000
# The sample that the ends of parts are taken from: so much text, or this share of a large corpus.
SAMPLE_BYTES = 1 << 23
SAMPLE_SHARE = 0.005


@dataclass
class Model:
    """The levels of the trie; ``documents`` is the count of the context at the begin of a text."""

    levels: list[Level] = field(default_factory=list)
    documents: int = 0

    @property
    def begin(self) -> int:
        return self.levels[0].entries

    @property
    def word_bits(self) -> int:
        """The bits of a word id in the keys of n-grams; the rest of 63 are those of its context."""
        if not self.levels:
            return 0
        bits = self.begin.bit_length()
        if max(self.begin, self.levels[-1].entries).bit_length() + bits > 63:
            raise OverflowError("n-grams of this level and its words need more than 63 bits")
        return bits

    def context_counts(self, contexts: np.ndarray) -> np.ndarray:
        """Counts of entries of the highest level in order, or of the begin of texts, which comes last."""
        if len(self.levels) > 1:
            return self.levels[-1].counts(contexts)
        words = contexts[: np.searchsorted(contexts, self.begin)]
        return np.append(self.levels[0].counts(words), np.full(len(contexts) - len(words), self.documents))

    def read(self, texts: pa.Array) -> Reading:
        """The words of texts and their entries on every level."""
        found = tokens(texts)
        hashes = np.concatenate([(found.hashes() >> np.uint64(1)).astype(np.int64) if len(found.distinct) else np.zeros(0, np.int64), [END]])
        order = np.argsort(hashes)
        ids = self.levels[0].find(hashes[order])
        # Ids are in the order of hashes; two words of one hash are one.
        known = ids >= 0
        new = known & (np.diff(hashes[order], prepend=-1) != 0)
        words, number = ids[new], np.empty(len(ids), dtype=np.int64)
        number[order] = np.where(known, np.cumsum(new) - 1, -1)
        # Each text is its begin, its words and its end.
        counts = np.diff(found.starts) + 2
        starts = np.concatenate([[0], np.cumsum(counts)])
        code = np.full(starts[-1], len(hashes) - 1, dtype=np.int64)
        code[starts[:-1]] = -1
        code[np.flatnonzero(_inner(starts))] = found.codes
        # The begin of a text comes after all words.
        token, number = code >= 0, np.append(number, len(words))[code]
        entries = [Found(np.append(words, self.begin), number)]
        word = np.where(token, number, -1)
        for level in self.levels[1:]:
            entries.append(_next(level, entries[-1], words, word))
        return Reading(starts, token, Found(words, word), entries)


def _inner(starts: np.ndarray) -> np.ndarray:
    marks = np.ones(starts[-1], dtype=bool)
    marks[starts[:-1]] = False
    marks[starts[1:] - 1] = False
    return marks


@dataclass
class Found:
    """Distinct ids in order, and for every place of some texts where its id stands in them, or -1."""

    distinct: np.ndarray
    place: np.ndarray

    def spread(self, values: np.ndarray, none) -> np.ndarray:
        """The values of the distinct ids at every place, and ``none`` where there is no id."""
        return np.append(values, none)[self.place]


def _next(level: Level, context: Found, words: np.ndarray, word: np.ndarray) -> Found:
    """The entries of a level from those of the level below that end one place before, and the words."""
    asked = np.flatnonzero((context.place[:-1] >= 0) & (word[1:] >= 0)) + 1
    # Numbers among the ids of these texts are in the order of ids and short enough to be sorted together with their places.
    pair = context.place[asked - 1] * len(words) + word[asked]
    pair, order = _ordered(pair, len(context.distinct) * len(words))
    # An n-gram that occurs more than once is looked up once.
    new = np.diff(pair, prepend=-1) != 0
    pair = pair[new]
    first = pair // max(1, len(words))
    entries = level.find((context.distinct[first] << level.word_bits) | words[pair - first * len(words)])
    known = entries >= 0
    place = np.full(len(word), -1, dtype=np.int64)
    place[asked[order]] = np.where(known, np.cumsum(known) - 1, -1)[np.cumsum(new) - 1]
    return Found(entries[known], place)


def _ordered(numbers: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below ``end`` in order, and where each one stood."""
    bits = len(numbers).bit_length()
    if end.bit_length() + bits > 63:
        order = np.argsort(numbers)
        return numbers[order], order
    both = np.sort((numbers << bits) | np.arange(len(numbers)))
    return both >> bits, both & ((1 << bits) - 1)


@dataclass
class Reading:
    """Texts as begins, words and ends: which are tokens, their words, and the entry that ends there on each level."""

    starts: np.ndarray
    token: np.ndarray
    words: Found
    found: list[Found]

    @property
    def word(self) -> np.ndarray:
        """The word ids of tokens, -1 if not in the vocabulary."""
        return self.words.spread(self.words.distinct, -1)

    @property
    def entries(self) -> list[np.ndarray]:
        return [level.spread(level.distinct, -1) for level in self.found]

    def count(self, model: Model) -> np.ndarray:
        """How often the word of each token was seen, zero for others."""
        return self.words.spread(model.levels[0].counts(self.words.distinct), 0)


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys in order and their counts: the bytes of steps and counts, place by place, compressed."""
    steps = np.diff(keys, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T
    numbers = counts.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps).tobytes() + np.ascontiguousarray(numbers).tobytes())


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), dtype=np.uint8).reshape(2, 8, -1)
    steps, counts = (np.ascontiguousarray(plane.T).view("<u8").reshape(-1).astype(np.int64) for plane in planes)
    return np.cumsum(steps), counts


def added(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    keys = np.concatenate([keys for keys, _ in pieces])
    counts = np.concatenate([counts for _, counts in pieces])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _dealt(keys: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """A block for each part; part ``i`` holds the keys below ``ends[i]``."""
    cuts = np.concatenate([[0], np.searchsorted(keys, ends), [len(keys)]])
    rows = [(part, packed(keys[a:b], counts[a:b])) for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["part", "block"])


def _summed(pieces: Iterator[np.ndarray], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of n-grams from the keys of one batch after the other, summed up to ``FLUSH_ENTRIES`` entries and more."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for keys in pieces:
        if len(keys):
            held.append(np.unique(keys, return_counts=True))
            size += len(held[-1][0])
        if size > 2 * FLUSH_ENTRIES:
            held = [added(held)]
            size = len(held[0][0])
            if size > FLUSH_ENTRIES:
                yield _dealt(*held[0], ends)
                held, size = [], 0
    if held:
        yield _dealt(*added(held), ends)


def _words(texts: pa.Array) -> np.ndarray:
    """The hashes of all words and ends of texts."""
    found = tokens(texts)
    hashes = (found.hashes() >> np.uint64(1)).astype(np.int64) if len(found.distinct) else np.zeros(0, np.int64)
    return np.concatenate([hashes[found.codes], np.full(len(texts), END, np.int64)])


def _entries(model: Model, texts: pa.Array, min_count: int) -> np.ndarray:
    """The keys of all n-grams of texts on the level above the highest."""
    read = model.read(texts)
    last, word = read.found[-1], read.words
    kept = read.token[1:] & (last.place[:-1] >= 0) & (last.place[1:] >= 0)
    if len(model.levels) == 1 and min_count > 1:
        count = read.count(model)
        kept &= (count[1:] >= min_count) & ((count[:-1] >= min_count) | ~read.token[:-1])
    kept = np.flatnonzero(kept)
    return (last.distinct[last.place[kept]] << model.word_bits) | word.distinct[word.place[kept + 1]]


def _keys(model: Model, texts: pa.Array, min_count: int) -> np.ndarray:
    return _entries(model, texts, min_count) if model.levels else _words(texts)


def _blocks(model: Model, ends: np.ndarray, min_count: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summed((_keys(model, batch.column("text"), min_count) for batch in slices(batches, size=LOOKUP_BYTES)), ends)

    return count


def _sampled(model: Model, min_count: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=LOOKUP_BYTES):
            found = np.unique(_keys(model, batch.column("text"), min_count))
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["key"])

    return keys


def _ends(model: Model, sample: DataFrame, parts: int, min_count: int) -> np.ndarray:
    """Where the parts of the next level end but the last; the driver gets these keys only."""
    if not model.levels or parts == 1:
        return np.array([(part << 63) // parts for part in range(1, parts)], dtype=np.int64)
    keys = sample.mapInArrow(_sampled(model, min_count), "key bigint").distinct()
    shares = [part / parts for part in range(1, parts)]
    found = keys.agg(F.percentile_approx("key", shares, 10 * parts).alias("ends")).first().ends
    return np.unique(np.array(found or [], dtype=np.int64))


def _built(folder: str, model: Model, min_count: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["part"]):
            keys, counts = added([unpacked(block.as_py()) for block in rows.column("block")])
            kept = counts >= min_count
            if not kept.any():
                continue
            if model.levels:
                yield shard_batch(build_entries(folder, keys[kept], counts[kept], model.word_bits, model.context_counts, DISCOUNT))
            else:
                yield shard_batch(build_words(folder, keys[kept], counts[kept]))

    return build


def _level(texts: DataFrame, ends: np.ndarray, model: Model, min_count: int) -> Level:
    """The next level from all n-grams of texts; the driver gets one row for each shard."""
    name = f"level-{len(model.levels) + 1}"
    blocks = texts.mapInArrow(_blocks(model, ends, min_count), "part int, block binary")
    dealt = blocks.repartition(len(ends) + 1, "part").sortWithinPartitions("part")
    folder = fresh_path(texts.sparkSession, name)
    rows = written(dealt.mapInArrow(_built(folder, model, min_count if model.levels else 1), SHARD_SCHEMA), f"{name}-shards")
    return Level([ShardRow(**row.asDict()) for row in rows.collect()], model.word_bits)


def trained(documents: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> Model:
    """A model of all texts of ``documents(text)``; 1 as ``min_count`` keeps all n-grams."""
    texts = documents.select("text")
    rows, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    # A word and the space behind it are two bytes at least, but six as a rule; parts may be of any size.
    parts = max(1, -(-(rows + (size or 0) // 6) // PART_TOKENS))
    share = min(1.0, max(SAMPLE_BYTES / max(1, size or 0), SAMPLE_SHARE))
    sample = written(texts.where(F.length("text") <= SAMPLE_BYTES).sample(share, seed=1), "sample") if parts > 1 else texts
    model = Model(documents=rows)
    for _ in range(order):
        model.levels.append(_level(texts, _ends(model, sample, parts, min_count), model, min_count))
    return model


def probabilities(model: Model, read: Reading) -> np.ndarray:
    """The probability of every place that is a token, in the context of its text."""
    norm = model.levels[0].total + model.levels[0].entries + 1
    chance = (read.count(model) + 1.0) / norm
    for level, context, own in zip(model.levels[1:], read.found, read.found[1:]):
        weight = context.spread(level.weights(context.distinct), 1.0)
        # A begin has no context; its probability is not used.
        chance[1:] *= weight[:-1]
        chance += own.spread(level.probabilities(own.distinct), 0.0)
    return chance


def _scores(model: Model, keep: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, distinct = model.levels[0].total, model.levels[0].entries
        for batch in slices(batches, size=LOOKUP_BYTES):
            read = model.read(batch.column("text"))
            count = read.count(model)

            def per_text(values: np.ndarray, read=read) -> np.ndarray:
                return np.add.reduceat(np.where(read.token, values, 0), read.starts[:-1])

            columns = {
                "n_tokens": np.diff(read.starts) - 1,
                "n_known": per_text((count > 0).astype(np.int64)),
                "train_tokens": np.full(batch.num_rows, total, dtype=np.int64),
                "base_score": per_text(np.log10((count + 1.0) / (total + distinct + 1))),
                "score": per_text(np.log10(probabilities(model, read))),
            }
            arrays = [*(batch.column(c) for c in keep), *map(pa.array, columns.values())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *columns])

    return score


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """The columns of the documents other than ``text``, and the counts and scores of their texts."""
    keep = [c for c in documents.columns if c != "text"]
    kept = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kept}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return documents.select(*keep, "text").mapInArrow(_scores(model, keep), schema)
