"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A document's fingerprint has a bit for each of 64 places: one where more than
half of the 64-bit hashes of its three-word shingles, repeats included, have a
one. Fingerprints with at most ``RADIUS`` differing bits are linked.

Every bit is given a nonzero vector of ``RADIUS + 1`` binary components, and
table ``v`` (any nonzero vector) keys a fingerprint by the bits whose vector is
not orthogonal to ``v``. The vectors of at most ``RADIUS`` differing bits have
a common nonzero ``v`` orthogonal to all of them, so that such a pair has the
same key in that table: no linked pair is missed, whatever the bits.

* Rows with equal fingerprints are one node from the start, whatever their number.
* A bucket of at most ``small`` nodes is compared node by node.
* Nodes of a larger bucket are not paired. Two fingerprints within two bits of
  each other have a value in common among themselves and their one-bit changes,
  and all that share such a value are within two bits: each value links its
  fingerprints to the smallest of them. It is linear in the nodes and exact.

A text without a word, null included, has the fingerprint zero and is linked
like any other. Rows that repeat a ``doc_id`` are one document: their
fingerprints are linked. A row without ``doc_id`` takes part with its text, and
its component is the smallest ``doc_id`` it reaches, null if there is none.
Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from folioseek.llm.common import WORD_BYTES, slices
from folioseek.llm.graph import components
from folioseek.sources.scratch import written

BITS = 64
RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42

# Nodes of a bucket that are compared with each other; larger buckets are linked by common values.
SMALL = 32

# Shingles whose hashes are held at a time.
BLOCK = 1 << 16

# One byte lane per bit of a byte, so that up to 255 rows add up without a carry.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
ROWS_PER_SUM = 255


def shingle_bounds(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts with a space after each, and where the shingles are.

    Returns the buffer, first and last byte of each shingle, and the first
    shingle of each text, with the number of all shingles at the end.
    """
    values = [value or b"" for value in texts.cast(pa.large_binary()).to_pylist()]
    joined = np.frombuffer(b"\n".join([*values, b""]).lower(), dtype=np.uint8)
    inside = WORD_BYTES[joined]
    follows = np.zeros(len(joined), dtype=bool)
    follows[1:] = inside[:-1]
    kept = inside | follows
    words = joined[kept]
    words[~inside[kept]] = ord(" ")
    ends = np.flatnonzero(words == ord(" "))
    starts = np.append(0, ends + 1)[:-1]
    lengths = np.array([len(value) + 1 for value in values], dtype=np.int64)
    before = np.append(0, np.cumsum(kept))[np.append(0, np.cumsum(lengths))]
    first = np.searchsorted(starts, before)
    count = np.diff(first)
    shingles = np.where(count > 0, np.maximum(count - SHINGLE_WORDS + 1, 1), 0)
    bounds = np.append(0, np.cumsum(shingles))
    word = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], shingles)
    last = word + np.repeat(np.minimum(count, SHINGLE_WORDS), shingles) - 1
    return words.tobytes(), starts[word], ends[last], bounds


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text as an unsigned 64-bit integer."""
    words, starts, ends, bounds = shingle_bounds(texts)
    view = memoryview(words)
    ones = np.zeros((len(texts), BITS), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for top in range(0, bounds[-1], BLOCK):
        low, high = starts[top : top + BLOCK].tolist(), ends[top : top + BLOCK].tolist()
        hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(low, high)), dtype="<u8", count=len(low))
        lanes = LANES[hashes.view(np.uint8)].reshape(-1, BITS // 8)
        place = np.arange(top, top + len(low))
        text = np.searchsorted(bounds, place, side="right") - 1
        cut = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (place % ROWS_PER_SUM == 0))
        sums = np.add.reduceat(lanes, cut, axis=0).view(np.uint8).reshape(len(cut), BITS)
        np.add.at(ones, text[cut], sums)
    majority = 2 * ones > np.diff(bounds)[:, None]
    return np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = pa.array(fingerprints(batch.column("text")).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints], ["doc_id", "print"])


def masks(radius: int = RADIUS) -> list[int]:
    """The bits that key each table; bits ``i`` and ``i + 2^(radius + 1) - 1`` have the same vector."""
    size = 1 << (radius + 1)
    vectors = [1 + bit % (size - 1) for bit in range(BITS)]
    return [sum(1 << bit for bit in range(BITS) if (vectors[bit] & v).bit_count() % 2) for v in range(1, size)]


def _long(value: int) -> Column:
    return F.lit(value - (1 << BITS) if value >> (BITS - 1) else value).cast("long")


def _tables(prints: DataFrame) -> DataFrame:
    """``(table, bucket, print)``, a row for each table."""
    keys = F.array(*[F.struct(F.lit(i).alias("table"), F.col("print").bitwiseAND(_long(mask)).alias("bucket")) for i, mask in enumerate(masks())])
    return prints.select("print", F.inline(keys)).select("table", "bucket", "print")


def _compared(rows: DataFrame) -> DataFrame:
    """Links inside buckets that are known to be small."""
    nodes = F.sort_array(F.collect_list("print"))
    near = lambda a: lambda b: (a < b) & (F.bit_count(a.bitwiseXOR(b)) <= RADIUS)
    pairs = F.transform("nodes", lambda a: F.transform(F.filter("nodes", near(a)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return rows.groupBy("table", "bucket").agg(nodes.alias("nodes")).select(F.inline(F.flatten(pairs)))


def _centred(prints: DataFrame) -> DataFrame:
    """Links of fingerprints that share a value among themselves and their one-bit changes."""
    changes = F.array(F.col("print"), *[F.col("print").bitwiseXOR(_long(1 << bit)) for bit in range(BITS)])
    centres = written(prints.select(F.explode(changes).alias("centre"), "print"), "centres")
    least = written(centres.groupBy("centre").agg(F.min("print").alias("b"), F.max("print").alias("most")).where("b < most"), "least")
    return centres.join(least, "centre").where("print > b").select(F.col("b").alias("a"), F.col("print").alias("b"))


def links(prints: DataFrame, small: int = SMALL) -> DataFrame:
    """``(a, b)``: links that join all distinct ``print`` within ``RADIUS`` bits, and no others."""
    keyed = _tables(prints)
    sizes = keyed.groupBy("table", "bucket").agg(F.count("*").alias("nodes")).where("nodes > 1")
    shared = written(keyed.join(written(sizes, "buckets"), ["table", "bucket"]), "shared")
    crowded = written(shared.where(F.col("nodes") > small).select("print").distinct(), "crowded")
    return _compared(shared.where(F.col("nodes") <= small)).unionByName(_centred(crowded)).distinct()


def near_duplicates(documents: DataFrame, small: int = SMALL) -> DataFrame:
    """``doc_id, fingerprint, component_id, n_links`` for every row of ``documents(doc_id, text)``.

    ``n_links`` counts the links of the fingerprint that were made to other
    fingerprints; in a crowded bucket one link to the smallest stands for many.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    signed = written(documents.select("doc_id", "text").mapInArrow(_signed, f"doc_id {kind}, print bigint"), "prints")
    nodes = written(signed.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    near = written(links(nodes.select("print"), small), "links")
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("most"))
    same = signed.join(written(several.where("a < most"), "several"), "doc_id").where("print > a").select("a", F.col("print").alias("b"))
    found = components(near.unionByName(written(same.distinct(), "same"))).withColumnRenamed("node", "print")
    labelled = written(nodes.join(found, "print", "left").withColumn("component", F.coalesce("component", "print")), "labelled")
    least = written(labelled.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    degree = near.select(F.explode(F.array("a", "b")).alias("print")).groupBy("print").agg(F.count("*").alias("n_links"))
    told = written(
        labelled.join(least, "component").join(degree, "print", "left").select("print", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "told",
    )
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return signed.join(told, "print").select("doc_id", digits.alias("fingerprint"), "component_id", "n_links")
