"""Tokens of two tokenizers aligned by bytes, and how often each pair of ids overlaps.

A text, with a space before it, is encoded by a byte-level BPE vocabulary (A)
and by a sentence-piece model (B). Where a token of both ends, a group ends. A
link is a pair of token occurrences whose byte ranges overlap; the count of a
pair of ids is the number of its links in all documents.

* First pass: documents are read in slices of ``SLICE_BYTES`` of text. A slice
  hands on its different pairs with their numbers of links, dealt by B id into
  ``SHARDS`` parts, so all pairs of a B id are in one of them.
* Pairs of a shard are made distinct in a tree of groups of slices and get a
  minimal perfect hash. Counts are vectors indexed by that hash, filled from
  the slices group by group and summed in a tree.
* A slice's pairs are looked up beside the shard they belong to, where the keys
  stored in hash order verify each of them, and come back with their count and
  whether it is the highest of their B id.
* Second pass: each slice's documents are aligned again and sum what was found.

A shard holds at most its B ids times all A ids, whatever the corpus. Both
encoders end a token wherever a space follows an ASCII sign or a letter of two
bytes, and start anew from that space. Texts are cut there, and each different
cut of a slice is encoded once.

Null and empty texts, and texts that one of the encoders does not give back
byte by byte, have no tokens: zeros and an empty ``groups_sha256``. Every row
is a document of its own, whether its ``doc_id`` is null or repeats. Columns
other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folioseek.llm.common import grouped, slices
from folioseek.llm.perfect_hash import PerfectHash, build
from folioseek.sources.scratch import written
from folioseek.sources.workers import loaded

TOKENIZERS = "/opt/tokenizers"
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"

# Fixed value: what the byte-level vocabulary takes as one word before it merges.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SLICE_BYTES = 8 << 20
SHARDS = 512

# Slices whose different pairs are joined in one group, and count vectors that are summed in one group.
FAN_IN = 1024
SUM_FAN_IN = 16

# Cuts of texts that a worker remembers, and that are encoded at a time.
REMEMBERED = 500_000
LONGEST = 64
UNITS_AT_A_TIME = 1 << 16

SPACE = ord(" ")
DIGESTED = 1 << 16


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes in
    order for the characters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in plain]
    return {chr(byte): byte for byte in plain} | {chr(256 + i): byte for i, byte in enumerate(others)}


@dataclass
class Encoders:
    """Both tokenizers, from the content of their files."""

    vocabulary: bytes
    model: bytes

    def __post_init__(self) -> None:
        alphabet = byte_alphabet()
        model = json.loads(self.vocabulary)["model"]
        self.a_bytes = [b""] * (1 + max(model["vocab"].values()))
        for token, number in model["vocab"].items():
            self.a_bytes[number] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        merged = ["".join(pair.split(" ") if isinstance(pair, str) else pair) for pair in model["merges"]]
        order = [model["vocab"][token] for token in merged]
        if order != sorted(order):
            raise ValueError("the vocabulary does not number its tokens in the order of its merges")
        ranks = {self.a_bytes[number]: number for number in [*map(model["vocab"].__getitem__, alphabet), *order]}
        self.a = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        self.b_size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.b_size)]
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode() for i, piece in enumerate(pieces)
        ]
        self.lone_space = [self.b.piece_to_id("▁")]
        self.a_lengths, self.b_lengths = (np.array([len(b) for b in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes))
        # Ids as they stand in the string of groups, after each sign that may be before them.
        a_ids, b_ids = ([b"%d" % i for i in range(n)] for n in (len(self.a_bytes), self.b_size))
        self.printed = [sign + i for sign in (b"", b";", b",") for i in a_ids] + [sign + i for sign in (b"|", b",") for i in b_ids]

    def encoded(self, units: list[bytes]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of A and B for cuts of texts, and where both give the bytes back; elsewhere there are no ids."""
        texts = [unit.decode("utf-8", "replace") for unit in units]
        encode = self.a.encode_ordinary
        a = [encode(text) for text in texts]
        b = self.b.encode([text[1:] for text in texts], num_threads=1)
        for i, text in enumerate(texts):
            if text == " ":
                b[i] = self.lone_space
        valid = np.ones(len(units), dtype=bool)
        whole, lengths = b"".join(units), np.array([len(unit) for unit in units])
        for ids, table, sizes in ((a, self.a_bytes, self.a_lengths), (b, self.b_bytes, self.b_lengths)):
            flat, count = _flat(ids)
            running = np.append(0, np.cumsum(sizes[flat]))
            bounds = np.append(0, np.cumsum(count))
            if b"".join(map(table.__getitem__, flat.tolist())) != whole or (np.diff(running[bounds]) != lengths).any():
                valid &= [b"".join(map(table.__getitem__, own)) == unit for own, unit in zip(ids, units, strict=True)]
        for i in np.flatnonzero(~valid):
            a[i], b[i] = [], []
        return a, b, valid


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    return np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(count.sum())), count


@dataclass
class Aligned:
    """Different cuts of some texts, aligned; arrays have a place for each cut or each link."""

    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    printed: list[bytes]
    link_unit: np.ndarray
    link_key: np.ndarray


class Memory:
    """Cuts that a worker has aligned, so that frequent ones are aligned once.

    It is emptied where it holds more than ``REMEMBERED`` cuts; a cut of more
    than ``LONGEST`` bytes counts for as many as it has room for.
    """

    def __init__(self) -> None:
        self.empty()

    def empty(self) -> None:
        self.place: dict[bytes, int] = {}
        self.printed: list[bytes] = []
        self.parts: list[Aligned] = []
        self.weight = 0

    def aligned(self, encoders: Encoders, units: list[bytes]) -> Aligned:
        """Tokens, groups and links of different cuts."""
        if self.weight > REMEMBERED:
            self.empty()
        place = self.place
        new = [unit for unit in units if unit not in place]
        for top in range(0, len(new), UNITS_AT_A_TIME):
            part = new[top : top + UNITS_AT_A_TIME]
            found = _aligned(encoders, part)
            place.update(zip(part, range(len(self.printed), len(self.printed) + len(part))))
            self.printed += found.printed
            self.parts.append(found)
            self.weight += len(part) + sum(map(len, part)) // LONGEST
        if len(self.parts) > 1:
            self.parts = [_joined(self.parts)]
        if not self.parts:
            none = np.zeros(0, np.int64)
            return Aligned(none.astype(bool), none, none, none, [], none, none)
        known = self.parts[0]
        own = np.fromiter(map(place.__getitem__, units), dtype=np.int64, count=len(units))
        bounds = np.searchsorted(known.link_unit, np.arange(len(known.valid) + 1))
        count = np.diff(bounds)[own]
        links = np.arange(count.sum()) + np.repeat(bounds[own] - (np.cumsum(count) - count), count)
        return Aligned(
            known.valid[own], known.n_a[own], known.n_b[own], known.n_groups[own],
            [self.printed[i] for i in own.tolist()], np.repeat(np.arange(len(units)), count), known.link_key[links],
        )


def _joined(parts: list[Aligned]) -> Aligned:
    """Parts one after the other; their texts stay where they are."""
    sizes = [len(part.valid) for part in parts]
    first = np.cumsum(sizes) - sizes
    columns = {name: np.concatenate([getattr(part, name) for part in parts]) for name in ("valid", "n_a", "n_b", "n_groups", "link_key")}
    return Aligned(**columns, printed=[], link_unit=np.concatenate([part.link_unit + start for part, start in zip(parts, first, strict=True)]))


def cuts(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Texts as cuts: the number of each cut, the different cuts, and the first cut of each text.

    A text has a space before it; null and empty texts have no cuts.
    """
    values = [b" " + value if value else b"" for value in texts.cast(pa.large_binary()).to_pylist()]
    buffer = b"".join(values)
    data = np.frombuffer(buffer, dtype=np.uint8)
    ends = np.cumsum([len(value) for value in values], dtype=np.int64)
    begins = np.append(0, ends)[:-1]
    spaces = np.flatnonzero(data == SPACE)
    spaces = spaces[spaces > 1]
    before, second = data[spaces - 1], data[spaces - 2]
    sign = (before > SPACE) & (before < 0x7F)
    letter = (before >= 0x80) & (second >= 0xC3) & (second <= 0xDF)
    marks = np.zeros(len(data), dtype=bool)
    marks[begins[ends > begins]] = True
    marks[spaces[sign | letter]] = True
    starts = np.flatnonzero(marks)
    bounds = np.append(starts, len(data)).astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(buffer)])
    coded = array.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, coded.dictionary.to_pylist(), np.searchsorted(starts, np.append(begins, len(data)))


def _aligned(encoders: Encoders, units: list[bytes]) -> Aligned:
    a_ids, b_ids, valid = encoders.encoded(units)
    (a, n_a), (b, n_b) = _flat(a_ids), _flat(b_ids)
    a_ends, b_ends = np.cumsum(encoders.a_lengths[a]), np.cumsum(encoders.b_lengths[b])
    # Between two neighbouring ends there is one token of each: a link.
    marks = np.zeros(a_ends[-1] + 1 if len(a_ends) else 0, dtype=bool)
    marks[a_ends] = marks[b_ends] = True
    ends = np.flatnonzero(marks)
    in_a, in_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    a_unit = np.repeat(np.arange(len(units)), n_a)
    both = (a_ends[in_a] == ends) & (b_ends[in_b] == ends)
    n_groups = np.bincount(a_unit[in_a[both]], minlength=len(units))
    return Aligned(valid, n_a, n_b, n_groups, _printed(encoders, a, b, a_ends, b_ends, ends[both], n_a, n_b, n_groups), a_unit[in_a], a[in_a] * encoders.b_size + b[in_b])


def _printed(encoders: Encoders, a, b, a_ends, b_ends, group_ends, n_a, n_b, n_groups) -> list[bytes]:
    """The groups of each cut as text, ``a1,a2|b1;a3|b2``."""
    a_group, b_group = np.searchsorted(group_ends, a_ends), np.searchsorted(group_ends, b_ends)
    new_a, new_b = (np.diff(group, prepend=-1) != 0 for group in (a_group, b_group))
    first_of_cut = np.zeros(len(a), dtype=bool)
    first_of_cut[(np.cumsum(n_a) - n_a)[n_a > 0]] = True
    size_a, size_b = len(encoders.a_bytes), encoders.b_size
    a_text = a + np.where(first_of_cut, 0, np.where(new_a, size_a, 2 * size_a))
    b_text = b + 3 * size_a + np.where(new_b, 0, size_b)
    order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
    texts = list(map(encoders.printed.__getitem__, np.concatenate([a_text, b_text])[order].tolist()))
    bounds = np.append(0, np.cumsum(n_a + n_b)).tolist()
    return [b"".join(texts[low:high]) for low, high in zip(bounds, bounds[1:])]


@dataclass(frozen=True)
class Source:
    """The two files, sent to the executors as one broadcast of some megabytes."""

    shared: object
    name: str

    def encoders(self) -> Encoders:
        return loaded(f"encoders {self.name}", lambda: Encoders(*self.shared.value))

    def memory(self) -> Memory:
        return loaded(f"encoded {self.name}", Memory)


def _whole_slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``size`` bytes of text, or one row with more."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in slices(batches):
        if held and n + batch.nbytes > size:
            yield pa.concat_batches(held)
            held, n = [], 0
        held.append(batch)
        n += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def _valid_texts(found: Aligned, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    wrong = np.append(0, np.cumsum(~found.valid[codes]))
    return (np.diff(first) > 0) & (wrong[first[1:]] == wrong[first[:-1]])


def _first_pass(source: Source, shards: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, memory = source.encoders(), source.memory()
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(_whole_slices(batches, slice_bytes)):
            codes, units, first = cuts(batch.column("text"))
            found = memory.aligned(encoders, units)
            of_valid = np.repeat(_valid_texts(found, codes, first), np.diff(first))
            times = np.bincount(codes[of_valid], minlength=len(units))
            keys, place = np.unique(found.link_key, return_inverse=True)
            counts = np.bincount(place, weights=times[found.link_unit], minlength=len(keys)).astype(np.int64)
            keys, counts = keys[counts > 0], counts[counts > 0]
            shard = keys % encoders.b_size % shards
            order = np.argsort(shard, kind="stable")
            keys, counts, shard = keys[order], counts[order], shard[order]
            own, starts = np.unique(shard, return_index=True)
            bounds = np.append(starts, len(keys)).tolist()
            n = len(batch)
            texts = [pa.array([task + number] * n, pa.int64()), batch.column("doc_id"), batch.column("text"), *(pa.nulls(n, kind) for kind in PAIR_KINDS)]
            pairs = [
                pa.array([task + number] * len(own), pa.int64()),
                pa.nulls(len(own), batch.column("doc_id").type),
                pa.nulls(len(own), batch.column("text").type),
                pa.array(own, pa.int32()),
                pa.array(np.diff(bounds), pa.int64()),
                *(pa.array([values[i:j].tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary()) for values in (keys, counts)),
            ]
            for rows in (texts, pairs):
                yield pa.RecordBatch.from_arrays(rows, FIRST_COLUMNS)

    return run


PAIR_KINDS = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
FIRST_COLUMNS = ["slice", "doc_id", "text", "shard", "n", "keys", "counts"]


def _longs(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.int64)


def _distinct(last: bool):
    """The different keys of each ``(shard, part)``; in the ``last`` round with their perfect hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, rows in _by_place(batches):
            keys, new, waiting = np.zeros(0, np.int64), [], 0
            for value in (row for batch in rows for row in batch.column("keys")):
                new.append(_longs(value))
                waiting += len(new[-1])
                if waiting > max(len(keys), 1 << 18):
                    keys, new, waiting = np.unique(np.concatenate([keys, *new])), [], 0
            keys = np.unique(np.concatenate([keys, *new]))
            levels = build(keys) if last else []
            if last:
                ordered = np.empty_like(keys)
                ordered[PerfectHash(levels).numbers(keys)] = keys
                keys = ordered
            yield pa.RecordBatch.from_arrays(
                [pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([levels], pa.list_(pa.binary()))],
                ["shard", "part", "n", "keys", "levels"],
            )

    return run


def _by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[pa.RecordBatch]]]:
    """The rows of each ``(shard, part)`` as a stream, of input sorted by them."""
    state: dict = {"batch": None}

    def step() -> bool:
        state["batch"] = next((batch for batch in batches if batch.num_rows), None)
        return state["batch"] is not None

    def own(place: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        while state["batch"] is not None or step():
            batch = state["batch"]
            same = (batch.column("shard").to_numpy() == place[0]) & (batch.column("part").to_numpy() == place[1])
            end = len(same) if same.all() else int(np.argmin(same))
            if end:
                yield batch.slice(0, end)
            state["batch"] = batch.slice(end) if end < len(same) else None
            if state["batch"] is not None:
                return

    while state["batch"] is not None or step():
        first = state["batch"]
        place = (first.column("shard")[0].as_py(), first.column("part")[0].as_py())
        rows = own(place)
        yield place, rows
        for _ in rows:
            pass


def _placed(frame: DataFrame, *order: str) -> DataFrame:
    return frame.repartition("shard", "part").sortWithinPartitions("shard", "part", *order)


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A vector of counts for each ``(shard, part)``, from a hash row and the slices' rows after it."""
    for place, rows in _by_place(batches):
        hashed = vector = None
        for batch in rows:
            for i in range(len(batch)):
                if hashed is None:
                    hashed = PerfectHash(batch.column("levels")[i].as_py())
                    vector = np.zeros(hashed.size, dtype=np.int64)
                else:
                    vector[hashed.numbers(_longs(batch.column("keys")[i]))] += _longs(batch.column("counts")[i])
        yield _vector(place, vector)


def _vector(place: tuple[int, int], vector: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int32()), pa.array([vector.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["shard", "part", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for place, rows in _by_place(batches):
        total = None
        for value in (row for batch in rows for row in batch.column("counts")):
            total = _longs(value).copy() if total is None else total + _longs(value)
        yield _vector(place, total)


def _looked_up(b_size: int):
    """Counts of the slices' pairs, and whether they are the highest of their B id, from the shard's row before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_place(batches):
            hashed = None
            for batch in rows:
                start = 0
                if hashed is None:
                    hashed = PerfectHash(batch.column("levels")[0].as_py())
                    stored, counts = _longs(batch.column("keys")[0]), _longs(batch.column("counts")[0])
                    own, place = np.unique(stored % b_size, return_inverse=True)
                    highest = np.zeros(len(own), dtype=np.int64)
                    np.maximum.at(highest, place, counts)
                    best = counts == highest[place]
                    start = 1
                results = []
                for value in batch.column("keys")[start:]:
                    keys = _longs(value)
                    number = hashed.numbers(keys)
                    if not (stored[number] == keys).all():
                        raise ValueError("a pair of ids is not among the pairs that were counted")
                    results.append((counts[number].tobytes(), best[number].tobytes()))
                if results:
                    found = [pa.array(column, pa.binary()) for column in zip(*results, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("slice")[start:], batch.column("keys")[start:], *found], ["slice", "keys", "counts", "best"])

    return run


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _second_pass(source: Source):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, memory = source.encoders(), source.memory()
        for rows in grouped(batches, ["slice"]):
            pairs = rows.filter(rows.column("is_text").cast(pa.int8()).to_numpy(zero_copy_only=False) == 0)
            texts = rows.slice(len(pairs))
            keys, counts, best = (
                np.frombuffer(b"".join(value.as_buffer() for value in pairs.column(name)), dtype=kind)
                for name, kind in (("keys", np.int64), ("counts", np.int64), ("best", bool))
            )
            order = np.argsort(keys, kind="stable")
            yield _measured(encoders, memory, texts, keys[order], counts[order], best[order])

    return run


def _measured(encoders: Encoders, memory: Memory, rows: pa.RecordBatch, keys: np.ndarray, counts: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    codes, units, first = cuts(rows.column("text"))
    found = memory.aligned(encoders, units)
    valid = _valid_texts(found, codes, first)
    # Links of texts without tokens may be missing among the keys; what is summed for them is not used.
    place = np.minimum(np.searchsorted(keys, found.link_key), max(len(keys) - 1, 0))
    known = keys[place] == found.link_key if len(keys) else np.zeros(len(place), dtype=bool)
    count = np.where(known, counts[place], 0) if len(keys) else np.zeros(len(place), dtype=np.int64)
    highest = known & best[place] if len(keys) else known
    n = len(units)
    count_sum = np.zeros(n, dtype=np.int64)
    np.add.at(count_sum, found.link_unit, count)
    per_unit = {
        "n_a": found.n_a,
        "n_b": found.n_b,
        "n_groups": found.n_groups,
        "n_links": np.bincount(found.link_unit, minlength=n),
        "n_best": np.bincount(found.link_unit[highest], minlength=n),
        "count_sum": count_sum,
    }
    columns = {"doc_id": rows.column("doc_id")}
    for name in SUMS:
        running = np.append(0, np.cumsum(per_unit[name][codes].astype(np.int64)))
        columns[name] = pa.array(np.where(valid, running[first[1:]] - running[first[:-1]], 0), pa.int64())
    digests = []
    for text in range(len(rows)):
        digest = sha256()
        for top in range(first[text], first[text + 1] if valid[text] else first[text], DIGESTED):
            part = codes[top : min(top + DIGESTED, first[text + 1])]
            digest.update((b";" if top > first[text] else b"") + b";".join(map(found.printed.__getitem__, part.tolist())))
        digests.append(digest.hexdigest() if valid[text] else "")
    columns["groups_sha256"] = pa.array(digests, pa.string())
    return pa.RecordBatch.from_pydict(columns)


def _with_part(pairs: DataFrame, parts: int) -> DataFrame:
    return pairs.withColumn("part", F.pmod(F.xxhash64("slice"), F.lit(parts)).cast("int"))


def pair_model(pairs: DataFrame, fan_in: int = FAN_IN) -> tuple[DataFrame, int]:
    """``shard, keys, levels, counts``: the different pairs of each shard in the order of their hash, and how often each occurs.

    ``pairs``: ``slice, shard, n, keys, counts``. Also returns over how many
    parts of the slices a shard's work is spread.
    """
    num_slices, entries = pairs.agg(F.count_distinct("slice"), F.coalesce(F.sum("n"), F.lit(0))).first()
    schema = "shard int, part int, n bigint, keys binary, levels array<binary>"
    parts = max(1, -(-num_slices // fan_in))
    keys = _with_part(pairs.select("slice", "shard", "keys"), parts).drop("slice")
    while parts > 1:
        keys = written(_placed(keys).mapInArrow(_distinct(False), schema), "keys").select("shard", "part", "keys")
        parts = -(-parts // fan_in)
        keys = keys.withColumn("part", (F.col("part") % parts).cast("int"))
    hashes = written(_placed(keys).mapInArrow(_distinct(True), schema), "hashes").drop("part")
    # As many vectors of a shard as make them a quarter of what they are summed from.
    distinct = hashes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    spread = parts = max(1, min(num_slices, entries // (4 * max(distinct, 1))))
    vectors = written(_beside(hashes.withColumn("counts", F.lit(None).cast("binary")), pairs, parts).mapInArrow(_dense, "shard int, part int, counts binary"), "vectors")
    while parts > 1:
        parts = -(-parts // SUM_FAN_IN)
        again = vectors.withColumn("part", (F.col("part") % parts).cast("int"))
        vectors = written(_placed(again).mapInArrow(_summed, "shard int, part int, counts binary"), "vectors")
    return written(hashes.join(vectors.select("shard", "counts"), "shard"), "model"), spread


def _beside(model: DataFrame, pairs: DataFrame, parts: int) -> DataFrame:
    """Each shard's row, once for every part of the slices, and after it the slices' rows of that shard and part."""
    first = model.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("slice"), "keys", "counts", "levels")
    rows = _with_part(pairs, parts).select("shard", "part", F.lit(1).alias("kind"), "slice", "keys", "counts", F.lit(None).cast("array<binary>").alias("levels"))
    return _placed(first.unionByName(rows), "kind")


def alignments(documents: DataFrame, folder: str = TOKENIZERS, shards: int = SHARDS, slice_bytes: int = SLICE_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``documents(doc_id, text)``.

    ``folder`` holds the two files of the tokenizers on the driver, which sends
    them to the executors.
    """
    spark = documents.sparkSession
    files = []
    for name in (BYTE_VOCABULARY, PIECE_MODEL):
        with open(f"{folder}/{name}", "rb") as file:
            files.append(file.read())
    source = Source(spark.sparkContext.broadcast(files), folder)
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"slice bigint, doc_id {kind}, text string, shard int, n bigint, keys binary, counts binary"
    first = written(documents.select("doc_id", "text").mapInArrow(_first_pass(source, shards, slice_bytes), schema), "slices")
    pairs = first.where("shard is not null").select("slice", "shard", "n", "keys", "counts")
    model, parts = pair_model(pairs, fan_in)
    b_size = sentencepiece.SentencePieceProcessor(model_proto=files[1]).get_piece_size()
    found = written(_beside(model, pairs, parts).mapInArrow(_looked_up(b_size), "slice bigint, keys binary, counts binary, best binary"), "found")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    of_pairs = found.select("slice", F.lit(False).alias("is_text"), none("doc_id", kind), none("text", "string"), "keys", "counts", "best")
    of_texts = first.where("shard is null").select("slice", F.lit(True).alias("is_text"), "doc_id", "text", none("keys", "binary"), none("counts", "binary"), none("best", "binary"))
    rows = of_pairs.unionByName(of_texts).repartition("slice").sortWithinPartitions("slice", "is_text")
    sums = ", ".join(f"{name} bigint" for name in SUMS)
    return rows.mapInArrow(_second_pass(source), f"doc_id {kind}, {sums}, groups_sha256 string")
