"""An n-gram trie in files that are mapped into memory.

Level 1 is the vocabulary: the 63-bit hashes of words in order, their counts
and their ids, which are their places. An entry of a higher level is a context
(an entry of the level below) and a word id; a key is
the context and, in as many bits as the vocabulary needs, the word. Entries stand in the order of
their keys, which are one rising sequence and Elias-Fano coded, so that the entry of a context
and a word is found by one search, without a look at where the entries of the context
begin and end. An entry carries its
count and its quantised discounted probability, a context its quantised
back-off weight.

A level is cut into shards by ranges of entries, each built by one task and
written to a file of its own in the shared folder. A task that is tried again
writes another file; the row that it returns names the one that counts. A
context may be spread over several shards. Readers map the files; on a file
system that cannot be mapped they map an unnamed copy.
"""

from __future__ import annotations

import json
import mmap
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs

from folioseek.llm.elias_fano import Monotone

# A code is a rounded-up number of 1024ths of a factor two below one, so that no probability is rounded up.
STEPS = 1024
LARGEST_CODE = 65535


def quantised(probabilities: np.ndarray) -> np.ndarray:
    codes = np.ceil(-np.log2(np.clip(probabilities, 2.0 ** -(LARGEST_CODE / STEPS), 1.0)) * STEPS - 1e-9)
    return np.clip(codes, 0, LARGEST_CODE).astype(np.uint16)


_PROBABILITIES = np.exp2(np.arange(LARGEST_CODE + 1) / -STEPS)


def restored(codes: np.ndarray) -> np.ndarray:
    return _PROBABILITIES[codes]


def smallest(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def write_arrays(uri: str, arrays: dict[str, np.ndarray], numbers: dict[str, int]) -> None:
    files, path = pa.fs.FileSystem.from_uri(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    places, at = {}, 0
    for name, array in arrays.items():
        places[name] = (array.dtype.str, at, len(array))
        at += -(-array.nbytes // 64) * 64
    head = json.dumps({"arrays": places, "numbers": numbers}).encode()
    with files.open_output_stream(path) as out:
        out.write(len(head).to_bytes(8, "little") + head + b"\0" * (-(len(head) + 8) % 64))
        for array in arrays.values():
            out.write(array.tobytes() + b"\0" * (-array.nbytes % 64))


def read_arrays(uri: str) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    files, path = pa.fs.FileSystem.from_uri(uri)
    if isinstance(files, pa.fs.LocalFileSystem):
        with open(path, "rb") as file:
            mapped = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with tempfile.TemporaryFile() as file, files.open_input_stream(path) as source:
            while piece := source.read(1 << 22):
                file.write(piece)
            file.flush()
            mapped = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(mapped[:8], "little")
    head = json.loads(mapped[8 : 8 + size])
    first = -(-(size + 8) // 64) * 64
    arrays = {
        name: np.frombuffer(mapped, dtype=np.dtype(kind), count=count, offset=first + at) for name, (kind, at, count) in head["arrays"].items()
    }
    return arrays, head["numbers"]


def _prefixed(name: str, sequence: Monotone) -> dict[str, np.ndarray]:
    return {f"{name}_{key}": array for key, array in sequence.arrays().items()}


def _sequence(name: str, arrays: dict[str, np.ndarray], numbers: dict[str, int]) -> Monotone:
    return Monotone(numbers[f"{name}_n"], numbers[f"{name}_width"], *(arrays[f"{name}_{key}"] for key in ("bits", "ones", "inner", "low")), distinct=True)


@dataclass(frozen=True)
class ShardRow:
    """What a task says about the shard that it wrote; keys are those of its first and last entry."""

    path: str
    first: int
    last: int
    entries: int
    total: int
    # What its first and last context lose to back-off in this shard.
    first_kept: float
    last_kept: float


SHARD_SCHEMA = "path string, first bigint, last bigint, entries bigint, total bigint, first_kept double, last_kept double"
_SHARD_ARROW = pa.schema(
    [("path", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("entries", pa.int64()), ("total", pa.int64())]
    + [("first_kept", pa.float64()), ("last_kept", pa.float64())]
)


def shard_batch(row: ShardRow) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row.__dict__], schema=_SHARD_ARROW)


def build_words(folder: str, keys: np.ndarray, counts: np.ndarray) -> ShardRow:
    """A shard of level 1 from hashes in order and their counts."""
    sequence = Monotone.of(keys - keys[0])
    arrays = _prefixed("keys", sequence) | {"counts": smallest(counts)}
    path = f"{folder}/{uuid4().hex}"
    write_arrays(path, arrays, {"keys_n": sequence.n, "keys_width": sequence.width})
    return ShardRow(path, int(keys[0]), int(keys[-1]), len(keys), int(counts.sum()), 0.0, 0.0)


def build_entries(folder: str, keys: np.ndarray, counts: np.ndarray, word_bits: int, context_counts, discount: float) -> ShardRow:
    """A shard of a higher level from keys ``context << word_bits | word`` in order and their counts.

    ``context_counts`` gives the counts of contexts in the level below.
    """
    context = keys >> word_bits
    low = int(context[0])
    begins = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    ends = np.append(begins[1:], len(keys))
    held = context[begins]
    totals = context_counts(held).astype(np.float64)
    share = (counts - discount) / np.repeat(totals, ends - begins)
    kept = np.add.reduceat(share, begins)
    kept_of = np.zeros(int(context[-1]) + 1 - low)
    kept_of[held - low] = kept
    # From the first key that the first context can have, so that a run of equal high bits is of one context, and even.
    sequence = Monotone.of(keys - (low << word_bits))
    arrays = _prefixed("keys", sequence) | {"counts": smallest(counts), "probabilities": quantised(share), "weights": quantised(1 - np.minimum(kept_of, 1.0))}
    path = f"{folder}/{uuid4().hex}"
    write_arrays(path, arrays, {"keys_n": sequence.n, "keys_width": sequence.width})
    return ShardRow(path, int(keys[0]), int(keys[-1]), len(keys), int(counts.sum()), float(kept[0]), float(kept[-1]))


class Level:
    """The shards of one level, mapped when they are first asked."""

    def __init__(self, rows: list[ShardRow], word_bits: int = 0):
        self.word_bits = word_bits
        self.rows = sorted(rows, key=lambda row: row.first)
        self.firsts = np.array([row.first for row in self.rows], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum([row.entries for row in self.rows])]).astype(np.int64)
        self.entries = int(self.offsets[-1])
        self.total = sum(row.total for row in self.rows)
        self._shards: dict[int, tuple[dict[str, np.ndarray], Monotone]] = {}
        # Back-off weights of contexts at the ends of shards, from all shards that hold a part of them.
        kept: dict[int, float] = {}
        for row in self.rows:
            ends = {row.first >> word_bits: row.first_kept}
            ends[row.last >> word_bits] = row.last_kept
            for context, share in ends.items():
                kept[context] = kept.get(context, 0.0) + share
        self.end_contexts = np.array(sorted(kept), dtype=np.int64)
        self.end_weights = restored(quantised(1 - np.minimum([kept[c] for c in sorted(kept)], 1.0))) if kept else np.zeros(0)

    def __getstate__(self) -> tuple[list[ShardRow], int]:
        return self.rows, self.word_bits

    def __setstate__(self, state: tuple[list[ShardRow], int]) -> None:
        self.__init__(*state)

    def _shard(self, number: int) -> tuple[dict[str, np.ndarray], Monotone]:
        if number not in self._shards:
            arrays, numbers = read_arrays(self.rows[number].path)
            self._shards[number] = (arrays, _sequence("keys", arrays, numbers))
        return self._shards[number]

    def _cuts(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The shards in whose ranges the keys lie, which are in order, and where in them."""
        if self.rows:
            cuts = np.append(np.searchsorted(keys, self.firsts), len(keys))
            for shard in np.flatnonzero(np.diff(cuts)):
                yield int(shard), slice(cuts[shard], cuts[shard + 1])

    def counts(self, entries: np.ndarray) -> np.ndarray:
        """Counts of entries in order."""
        return self._values(entries, "counts").astype(np.int64)

    def probabilities(self, entries: np.ndarray) -> np.ndarray:
        """Discounted probabilities of entries in order."""
        return restored(self._values(entries, "probabilities"))

    def _values(self, entries: np.ndarray, name: str) -> np.ndarray:
        result = np.zeros(len(entries), dtype=np.int64)
        cuts = np.searchsorted(entries, self.offsets)
        for shard in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[shard], cuts[shard + 1])
            result[own] = self._shard(int(shard))[0][name][entries[own] - self.offsets[shard]]
        return result

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entries of keys in order, or the ids of hashes, -1 if there is none."""
        found = np.full(len(keys), -1, dtype=np.int64)
        for shard, own in self._cuts(keys):
            local = self._shard(shard)[1].find(keys[own] - (self.rows[shard].first >> self.word_bits << self.word_bits))
            found[own] = np.where(local >= 0, local + self.offsets[shard], -1)
        return found

    def weights(self, contexts: np.ndarray) -> np.ndarray:
        """Back-off weights of contexts in order; one for a context without entries."""
        weight = np.ones(len(contexts))
        if not self.rows or not len(contexts):
            return weight
        for shard, own in self._cuts((contexts << self.word_bits) | ((1 << self.word_bits) - 1)):
            weights = self._shard(shard)[0]["weights"]
            local = contexts[own] - (self.rows[shard].first >> self.word_bits)
            # Those beyond the last context of the shard come last.
            inside = local[: np.searchsorted(local, len(weights))]
            weight[own.start : own.start + len(inside)] = restored(weights[inside])
        at = np.minimum(np.searchsorted(self.end_contexts, contexts), len(self.end_contexts) - 1)
        return np.where(self.end_contexts[at] == contexts, self.end_weights[at], weight)
