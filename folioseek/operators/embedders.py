"""Embedders: text to vectors on executors, and scores of vectors per Arrow batch.

An embedder has a ``name`` and a ``dim`` that are stored with an index, the
``prefix`` that its questions get (none for terms, which would be searched
for like words of the question),
``vectorize`` for texts and ``vectorize_chunks`` for chunks of the native
chunker, ``prepare`` for what scoring needs to know of the whole index, and
``scorer`` for a bounded block of question vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioseek.functions.prompts import QUESTION_PREFIX
from folioseek.functions.text import tokens
from folioseek.functions.vectors import DEFAULT_DIM, hashed_vector
from folioseek.sources.workers import loaded

# Scores are computed for at most this many chunk x question cells at a time.
TILE_CELLS = 1_000_000


def bucket_weight(df: Column, num_chunks: Column) -> Column:
    """Integer rarity of a bucket: the bit length of ``num_chunks div df``.

    It is 1 for a bucket found in more than half of the chunks and grows by one
    each time the bucket gets half as common, so every bucket counts and all
    sums stay integers.
    """
    share = F.call_function("div", num_chunks, F.greatest(df, F.lit(1)))
    return F.length(F.bin(share))


@dataclass(frozen=True)
class HashedTerms:
    """Built-in sparse embedder: hashed term frequencies, scored by cosine."""

    dim: int = DEFAULT_DIM
    name: str = "hashed-terms"
    column: str = "vec"
    prefix: str = ""
    uses_statistics = True

    def vectorize(self, texts: DataFrame, text: str = "text") -> DataFrame:
        return texts.withColumn(self.column, hashed_vector(tokens(F.col(text)), self.dim))

    def vectorize_chunks(self, chunks: DataFrame) -> DataFrame:
        """The same for chunks, whose tokens are known to have one space between them."""
        words = F.array_remove(F.split("text", " "), "")
        return chunks.withColumn(self.column, hashed_vector(words, self.dim))

    def cells(self) -> Column:
        """How much of a block of questions one question takes up."""
        return F.size(self.column)

    def statistics(self, chunks: DataFrame) -> DataFrame:
        """In how many chunks each bucket occurs; at most ``dim`` rows.

        A bucket that is in every chunk is counted up before the shuffle, so
        it sends one row per task and not one per chunk.
        """
        buckets = chunks.select(F.explode(F.array_distinct(self.column)).alias("bucket"))
        return buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))

    def prepare(self, statistics: DataFrame, num_chunks: int) -> np.ndarray:
        """Squared weight per bucket."""
        weighted = statistics.select(
            "bucket", bucket_weight(F.col("df"), F.lit(num_chunks)).cast("long").alias("weight")
        )
        # At most ``dim`` rows of two numbers, whatever the size of the index.
        known = weighted.toArrow()
        weights = np.full(self.dim, max(num_chunks, 1).bit_length(), dtype=np.int64)
        weights[known["bucket"].to_numpy()] = known["weight"].to_numpy()
        return weights * weights

    def scorer(self, vectors: Sequence, prepared: np.ndarray) -> SparseScorer:
        return SparseScorer(vectors, prepared)


def term_runs(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, bucket, tf)`` of hashed vectors laid end to end."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(flat, prepend=-1))
    return row[starts], flat[starts], np.diff(starts, append=len(flat))


class SparseScorer:
    """Cosine of weighted term frequencies against a block of questions."""

    def __init__(self, vectors: Sequence, squared_weights: np.ndarray) -> None:
        flat = np.concatenate([np.asarray(v, np.int64) for v in (*vectors, [])])
        owner, bucket, tf = term_runs(flat, np.array([len(v) for v in vectors], np.int64))
        worth = tf * squared_weights[bucket]
        order = np.argsort(bucket, kind="stable")
        self.num_questions = len(vectors)
        self.squared_weights = squared_weights
        self.norms = np.bincount(owner, weights=tf * worth, minlength=len(vectors))
        # Questions by bucket: those of bucket b are first[b] .. first[b + 1].
        self.first = np.searchsorted(bucket[order], np.arange(len(squared_weights) + 1))
        self.owner = owner[order]
        self.worth = worth[order].astype(np.float64)

    def floor(self) -> float:
        """A score has to be above this to count."""
        return 0.0

    def tiles(self, vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
        """First row and ``rows x questions`` scores of successive slices."""
        offsets = vectors.offsets.to_numpy().astype(np.int64)
        flat = vectors.values.to_numpy().astype(np.int64)
        rows = max(1, TILE_CELLS // max(self.num_questions, 1))
        for top in range(0, len(vectors), rows):
            ends = offsets[top : top + rows + 1]
            yield top, self._scores(*term_runs(flat[ends[0] : ends[-1]], np.diff(ends)), len(ends) - 1)

    def _scores(self, row: np.ndarray, bucket: np.ndarray, tf: np.ndarray, num_rows: int) -> np.ndarray:
        norms = np.bincount(row, weights=tf * tf * self.squared_weights[bucket], minlength=num_rows)
        dots = np.zeros(num_rows * self.num_questions)
        asked = self.first[bucket + 1] - self.first[bucket]
        hit = np.flatnonzero(asked)
        # One pass takes up about TILE_CELLS products.
        passes = np.cumsum(asked[hit]) // TILE_CELLS
        for at in np.split(hit, np.flatnonzero(np.diff(passes)) + 1):
            count = asked[at]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            posting = np.repeat(self.first[bucket[at]], count) + within
            cell = np.repeat(row[at], count) * self.num_questions + self.owner[posting]
            products = np.repeat(tf[at], count) * self.worth[posting]
            dots += np.bincount(cell, weights=products, minlength=len(dots))
        dots = dots.reshape(num_rows, self.num_questions)
        lengths = np.sqrt(norms[:, None] * self.norms[None, :])
        return np.divide(dots, lengths, out=np.zeros_like(dots), where=lengths > 0)


@dataclass(frozen=True)
class UserVectors:
    """Dense embedder around a user's model, scored by squared distance.

    ``encode`` takes a list of texts and returns as many vectors of ``dim``
    numbers. It is called per Arrow batch on the executors. A model that is
    large to send or slow to start is given as ``load`` instead, which returns
    such a function and is called once per Python worker.
    """

    name: str
    dim: int
    encode: Callable[[list[str]], Sequence[Sequence[float]]] | None = None
    column: str = "vec"
    prefix: str = QUESTION_PREFIX
    load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]] | None = None
    uses_statistics = False

    def vectorize(self, texts: DataFrame, text: str = "text") -> DataFrame:
        name, encode, load, dim = self.name, self.encode, self.load, self.dim

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            run = encode if load is None else loaded(name, load)
            for values in batches:
                vectors = np.asarray(run(values.fillna("").tolist()), dtype=np.float32)
                if vectors.shape != (len(values), dim):
                    raise ValueError(f"expected {len(values)} vectors of {dim}, got {vectors.shape}")
                yield pd.Series(list(vectors))

        return texts.withColumn(self.column, embed(F.col(text)))

    def vectorize_chunks(self, chunks: DataFrame) -> DataFrame:
        return self.vectorize(chunks)

    def cells(self) -> Column:
        return F.lit(self.dim)

    def statistics(self, chunks: DataFrame) -> None:
        return None

    def scorer(self, vectors: Sequence, prepared: None) -> DenseScorer:
        return DenseScorer(vectors, self.dim)


class DenseScorer:
    """Negated squared distance, so the largest is nearest.

    The squares of the differences are added up dimension by dimension, always
    in the same order and without rounding: close vectors stay apart, and a
    distance does not depend on what else is in a batch.
    """

    def __init__(self, vectors: Sequence, dim: int) -> None:
        self.num_questions = len(vectors)
        self.dim = dim
        self.questions = np.asarray(vectors, dtype=np.float64).reshape(len(vectors), dim)

    def floor(self) -> float:
        return -np.inf

    def tiles(self, vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(flat) != len(vectors) * self.dim:
            raise ValueError(f"a vector does not have {self.dim} numbers")
        stored = flat.reshape(len(vectors), self.dim)
        rows = max(1, TILE_CELLS // max(self.num_questions, 1))
        for top in range(0, len(stored), rows):
            part = stored[top : top + rows]
            distance = np.zeros((len(part), self.num_questions))
            for place in range(self.dim):
                difference = part[:, place, None] - self.questions[None, :, place]
                distance += difference * difference
            yield top, -distance


_FACTORIES: dict[str, Callable[[], object]] = {"hashed-terms": HashedTerms}


def register_embedder(name: str, make: Callable[[], object]) -> None:
    """Say how the embedder of a name is made, such as that of a model's settings."""
    _FACTORIES[name] = make


def embedder_named(name: str):
    """The embedder of a name, as ``ModelSettings.embedding_model`` has it."""
    if name not in _FACTORIES:
        raise KeyError(f"no embedder for {name!r}; known: {sorted(_FACTORIES)}")
    return _FACTORIES[name]()
