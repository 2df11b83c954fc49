"""Words, hashes and small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The characters that end a word: space and the five ASCII controls from tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Text of one Arrow batch that is worked on at a time; the arrays made from it are a few dozen times as large.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_RUN), lambda word: word != "")


def lowered(text: Column) -> Column:
    """The text with A-Z lower-cased and every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def byte_class(members: bytes) -> np.ndarray:
    marks = np.zeros(256, dtype=bool)
    marks[np.frombuffer(members, dtype=np.uint8)] = True
    return marks


WORD_BYTES = ~byte_class(WHITE.encode())
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[ord("A") : ord("Z") + 1] += 32


@dataclass
class Tokens:
    """The words of some texts: ``codes`` points into ``distinct``, text ``i`` has ``codes[starts[i]:starts[i + 1]]``."""

    codes: np.ndarray
    starts: np.ndarray
    distinct: pa.BinaryArray

    def of(self, text: int) -> np.ndarray:
        return self.codes[self.starts[text] : self.starts[text + 1]]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word: a sum of random numbers for its bytes at their places."""
        if not len(self.distinct):
            return np.zeros(0, np.uint64)
        _, offsets, data = self.distinct.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int32)[self.distinct.offset : self.distinct.offset + len(self.distinct) + 1].astype(np.int64)
        data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
        lengths, starts = np.diff(offsets), offsets[:-1] - offsets[0]
        place = np.arange(len(data)) - np.repeat(starts, lengths)
        values = BYTE_NUMBERS[place & (len(BYTE_NUMBERS) - 1), data]
        if lengths.max() > len(BYTE_NUMBERS):
            values = values * (mixed((place // len(BYTE_NUMBERS)).astype(np.uint64)) | np.uint64(1))
        return mixed(np.add.reduceat(values, starts) + lengths.astype(np.uint64))


def tokens(texts: pa.Array, members: np.ndarray = WORD_BYTES) -> Tokens:
    """The lower-cased words of texts: runs of bytes for which ``members`` holds. Null has none.

    Works on the bytes of the Arrow array, so that no word becomes a Python
    object before words are made distinct.
    """
    texts = pa.concat_arrays([texts.cast(pa.large_binary()).fill_null(b"")])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(offsets[-1] - offsets[0])
    if not size:
        return Tokens(np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), pa.array([], pa.binary()))
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = members.take(data)
    follows = np.empty(size, dtype=bool)
    follows[0] = False
    follows[1:] = inside[:-1]
    follows[offsets[:-1][offsets[:-1] < size]] = False
    # A word goes on up to a byte outside of it or the first byte of a text or word after it.
    goes_on = np.append(inside[1:] & follows[1:], False)
    begins, lasts = np.flatnonzero(inside & ~follows), np.flatnonzero(inside & ~goes_on)
    letters = LOWER_BYTES.take(np.compress(inside, data))
    bounds = np.append(0, np.cumsum(lasts - begins + 1)).astype(np.int32)
    found = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    coded = found.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Tokens(codes, np.searchsorted(begins, offsets), coded.dictionary)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with about ``size`` bytes of text (``SLICE_BYTES``), or one row with more."""
    size = size or SLICE_BYTES
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(first, last - first)
            first = last
        # What a batch took is given back before the next one comes.
        pa.default_memory_pool().release_unused()


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each key together, of input sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        found = list(zip(*(batch.column(key).to_pylist() for key in keys), strict=True))
        first = 0
        while first < len(found):
            end = first
            while end < len(found) and found[end] == found[first]:
                end += 1
            if held and found[first] != last:
                yield pa.concat_batches(held)
                held = []
            last = found[first]
            held.append(batch.slice(first, end - first))
            first = end
    if held:
        yield pa.concat_batches(held)


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit integers with every output bit depending on every input bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


# Random numbers for 64 places and 256 bytes; further places take a multiple of them.
BYTE_NUMBERS = mixed(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(64, 256)


def numbers(seed: str, count: int) -> np.ndarray:
    """Odd 64-bit integers that a name stands for, the same on every machine."""
    return np.array([xxhash.xxh3_64_intdigest(f"{seed} {i}".encode()) | 1 for i in range(count)], dtype=np.uint64)


def crc_rest(doc_id: Column, divisor: int) -> Column:
    """``crc32(doc_id as text) mod divisor``, which deals documents into folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor
