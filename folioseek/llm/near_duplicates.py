"""Near duplicates by min-max hashing.

A document is the set of its distinct word shingles. Every permutation of the
shingles gives two values of the signature, its minimum and its maximum, each
equal for two sets with the probability of their similarity, so that 64 hash
evaluations make 128 values. ``ROWS`` values make a band; two sets that share
a band are candidates, and candidates are links once their full sets confirm it.

* Equal sets are one class from the start, whatever their number. A class has a
  number of its own; ids of documents come in at the end.
* In the bucket of a band every class is compared with two of its members
  chosen by hash, which joins nearly all of a group in linear work. What is
  still in different components of one bucket after that is compared with each
  other, so no link is lost to the choice. These pairs must share as many bands
  as all but one in a million pairs at the threshold do (``shared_bands``).
* No bucket, class or component is gathered in one task or on the driver.

A row without words is linked with nothing. Rows that repeat a ``doc_id`` are
one document: they share its component, and so do texts of all of them. A row without ``doc_id`` cannot be
compared; it has no component and is kept. Columns other than ``doc_id`` and
``text`` are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from folioseek.llm.common import grouped, mixed, numbers, slices, tokens
from folioseek.llm.graph import components
from folioseek.sources.scratch import written

PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
BLOCK = 1 << 14
PART = 512
# Shingles of sets that are compared at once.
MEMBERS = 1 << 19


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles of ``size`` words.

    A text with fewer words is one shingle, one without words has none.
    """
    found = tokens(texts)
    hashes = mixed(found.hashes() if len(found.distinct) else np.zeros(0, np.uint64))
    factors = numbers("shingle", size)
    for text in range(len(texts)):
        own = hashes[found.of(text)]
        if not len(own):
            yield own
            continue
        length = min(size, len(own))
        total = np.full(len(own) - length + 1, length, dtype=np.uint64)
        for place in range(length):
            total += own[place : len(own) - length + 1 + place] * factors[place]
        yield np.unique(mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """One hash for each band of minima, then for each band of maxima."""
    factors, offsets = numbers("permutation", PERMUTATIONS), numbers("offset", PERMUTATIONS)
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    most = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for first in range(0, len(shingles), BLOCK):
        values = np.multiply.outer(factors, shingles[first : first + BLOCK])
        values += offsets[:, None]
        np.minimum(least, values.min(axis=1), out=least)
        np.maximum(most, values.max(axis=1), out=most)
    rows = (np.concatenate([least, most]) >> np.uint64(24)).reshape(BANDS, ROWS)
    bands = np.arange(BANDS, dtype=np.uint64)
    for row in rows.T:
        bands = mixed(bands * np.uint64(0x9E3779B97F4A7C15) + row)
    return bands.view(np.int64)


def _sets(size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices([whole])):
            sets = list(shingle_sets(batch.column("text"), size))
            sets = [s.tobytes() for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"]
            )

    return make


def _signed(size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(shingle_sets(batch.column("text"), size))
            bands = [signature(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            offsets = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands))),
                ],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return make


def _confirmed(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                a, b = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (a, b))
                common = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))
            pa.default_memory_pool().release_unused()

    return confirm


def _shingles(texts: DataFrame, classes: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``class, shingles``: the full sets of the classes ``ids``, made from the text of one document of each."""
    wanted = written(classes.join(ids, "class", "left_semi").select("class", "digest", "least"), "wanted")
    of_these = texts.join(wanted.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")
    made = of_these.mapInArrow(_sets(size), "digest binary, shingles binary")
    # A document that repeats may have other sets too.
    return written(made.join(wanted.select("digest", "class"), "digest").dropDuplicates(["class"]).select("class", "shingles"), "sets")


def _links(pairs: DataFrame, texts: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose full sets are similar enough."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "ids")
    sets = _shingles(texts, classes, ids, size)
    b = sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b"))
    a = sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a"))
    return written(pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(percent), "a bigint, b bigint"), "links")


def _repeated(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of the classes that one repeated ``doc_id`` has."""
    named = signed.where("doc_id is not null and digest is not null")
    several = named.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).where("one < other")
    pairs = named.join(written(several, "several"), "doc_id").where("digest > one").select("one", "digest").distinct()
    of = lambda digest, name: classes.select(F.col("digest").alias(digest), F.col("class").alias(name))
    return written(pairs, "repeated").join(of("one", "a"), "one").join(of("digest", "b"), "digest").select("a", "b")


def near_duplicates(documents: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, n_links`` for every row of ``documents(doc_id, text)``.

    Two documents are linked if ``100 * intersection >= percent * union``. The
    component is the smallest ``doc_id`` that links reach; that document is
    kept. ``n_links`` counts the links that were confirmed to other sets of
    the component, zero for a set that stands alone or only has equal copies.
    """
    texts = documents.select("doc_id", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    signed = written(
        texts.mapInArrow(_signed(shingle_words), f"doc_id {kind}, n_shingles bigint, digest binary, bands array<bigint>"), "signed"
    )
    classes = written(
        signed.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    members = classes.select("class", "n", F.explode("bands").alias("band"))
    place = F.xxhash64("class", "band")
    hubs = written(
        members.groupBy("band")
        .agg(
            F.count("*").alias("size"),
            F.min(F.struct(place.alias("place"), F.col("class").alias("hub"), F.col("n").alias("hub_n"))).alias("first"),
            F.max(F.struct(place.alias("place"), F.col("class").alias("hub"), F.col("n").alias("hub_n"))).alias("last"),
        )
        .where("size > 1")
        .select("band", F.explode(F.array("first", "last")).alias("hub"))
        .select("band", "hub.hub", "hub.hub_n"),
        "hubs",
    )
    crowded = members.join(hubs, "band").select("class", "n", "hub", "hub_n")
    near = F.col("class") != F.col("hub")
    near &= 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    pair = (F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b"))
    links = _links(written(crowded.where(near).select(*pair).distinct(), "pairs"), texts, classes, shingle_words, percent)
    shared = members.join(hubs.select("band").distinct(), "band", "left_semi")
    links = links.unionByName(_links_apart(shared, components(links), classes, texts, shingle_words, percent))
    found = components(links.unionByName(_repeated(signed, classes))).withColumnRenamed("node", "class")
    labelled = classes.select("digest", "class", "least").join(written(found, "components"), "class", "left")
    labelled = written(labelled.withColumn("part", F.coalesce("component", "class")).select("digest", "class", "least", "part"), "labelled")
    smallest = written(labelled.groupBy("part").agg(F.min("least").alias("component")), "smallest")
    # Summed by each side first, so that a link never becomes two rows.
    sides = [links.groupBy(F.col(side).alias("class")).agg(F.count("*").alias("n")) for side in ("a", "b")]
    degree = sides[0].unionByName(sides[1]).groupBy("class").agg(F.sum("n").alias("n_links"))
    joined = written(
        labelled.join(smallest, "part").join(degree, "class", "left").select("digest", "component", F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "joined",
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return signed.select("doc_id", "n_shingles", "digest").join(joined, "digest", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def shared_bands(percent: int) -> int:
    """The most bands that a pair at the threshold shares with a probability of 0.999999 or more."""
    equal = (percent / 100) ** ROWS
    missed = 0.0
    for bands in range(BANDS):
        missed += comb(BANDS, bands) * equal**bands * (1 - equal) ** (BANDS - bands)
        if missed > 1e-6:
            return max(1, bands)
    return BANDS


def _candidates(rows: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs in different components that must be compared, in this bucket and these two parts only."""
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    part = rows.column("part").to_numpy()
    band = rows.column("band")[0].as_py()
    n = rows.column("n").to_numpy()
    component = np.unique(rows.column("component").to_numpy(zero_copy_only=False), return_inverse=True)[1]
    bands = rows.column("bands").flatten().to_numpy().reshape(len(n), BANDS)
    column = int(np.flatnonzero((bands == band).all(axis=0))[0])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(part == low):
        others = np.flatnonzero((part == high) & (component != component[i]))
        others = others[others > i] if low == high else others
        size = np.minimum(n[others], n[i]) * 100 >= percent * np.maximum(n[others], n[i])
        others = others[size]
        equal = bands[others] == bands[i]
        # Of all buckets that a pair shares, only that of its first common band compares it.
        own = (equal.sum(axis=1) >= shared_bands(percent)) & (equal.argmax(axis=1) == column)
        found.append((np.full(int(own.sum()), i), others[own]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _suspects(percent: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["band", "low", "high"]):
            places = np.unique(np.concatenate(_candidates(rows, percent)))
            if len(places):
                yield rows.take(pa.array(places))

    return keep


def _linked(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Those of the pairs ``a, b`` whose sets are similar enough; ``a`` is in order.

    The sets are cut into runs of about ``MEMBERS`` shingles, or one set with
    more, and two runs meet at a time.
    """
    if not len(a):
        return []
    run = np.cumsum([len(s) for s in sets]) // MEMBERS
    meeting = run[a] * (run[-1] + 1) + run[b]
    return [pair for own in np.unique(meeting) for pair in _linked_runs(sets, a[meeting == own], b[meeting == own], percent)]


def _linked_runs(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """As ``_linked``, at once.

    The members of one set are marked, and the marks are summed over all the
    sets that it is compared with.
    """
    used = np.unique(np.concatenate([a, b]))
    sizes = np.array([len(sets[u]) for u in used])
    starts = np.cumsum(sizes) - sizes
    members = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)[1]
    marks = np.zeros(len(members), dtype=np.int64)
    linked = []
    for own, first, count in zip(*np.unique(a, return_index=True, return_counts=True), strict=True):
        others = np.searchsorted(used, b[first : first + count])
        ends = np.cumsum(sizes[others])
        places = np.arange(ends[-1]) + np.repeat(starts[others] - (ends - sizes[others]), sizes[others])
        place = np.searchsorted(used, own)
        mine = members[starts[place] : starts[place] + sizes[place]]
        marks[mine] = 1
        common = np.add.reduceat(marks[members[places]], ends - sizes[others])
        marks[mine] = 0
        near = 100 * common >= percent * (sizes[place] + sizes[others] - common)
        linked += [(int(own), int(used[other])) for other in others[near]]
    return linked


def _compared(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["band", "low", "high"]):
            sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in rows.column("shingles")]
            linked = _linked(sets, *_candidates(rows, percent), percent)
            if linked:
                ids = rows.column("class")
                a, b = (ids.take(pa.array(places)) for places in zip(*linked, strict=True))
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])
            pa.default_memory_pool().release_unused()

    return compare


def _links_apart(members: DataFrame, found: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between members of one bucket that are in different components so far.

    A bucket is cut into parts of about ``PART`` members, and every two parts
    meet in one group: a bucket of any size is many small groups, and a pair of
    documents is never a row.
    """
    labelled = written(
        members.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn(
            "component", F.coalesce("component", "class")
        ),
        "labelled",
    )
    several = (
        labelled.groupBy("band")
        .agg(F.min("component").alias("one"), F.max("component").alias("other"), F.count("*").alias("size"))
        .where("one <> other")
        .select("band", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = (
        written(labelled.join(written(several, "several"), "band"), "several")
        .join(classes.select("class", "bands"), "class")
        .withColumn("part", part)
        .withColumn("other", other)
        .select("band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "class", "n", "component", "bands")
    )
    schema = "band bigint, low int, high int, part int, class bigint, n bigint, component bigint, bands array<bigint>"
    keys = ["band", "low", "high"]
    suspects = written(left.repartition(*keys).sortWithinPartitions(*keys, "class").mapInArrow(_suspects(percent), schema), "suspects")
    sets = _shingles(texts, classes, written(suspects.select("class").distinct(), "ids"), size)
    return written(
        suspects.join(sets, "class")
        .select(*suspects.columns, "shingles")
        .repartition(*keys)
        .sortWithinPartitions(*keys, "class")
        .mapInArrow(_compared(percent), "a bigint, b bigint"),
        "links",
    )
