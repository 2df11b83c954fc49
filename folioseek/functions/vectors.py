"""Sparse hashed term-frequency vectors as native columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioseek.functions.text import let

# Fixed value: number of buckets tokens are hashed into.
DEFAULT_DIM = 2**18


def token_bucket(token: Column, dim: int = DEFAULT_DIM) -> Column:
    """Bucket of a token from the CRC-32 of its UTF-8 bytes."""
    return (F.crc32(token) % dim).cast("int")


def hashed_vector(words: Column, dim: int = DEFAULT_DIM) -> Column:
    """Buckets of tokens, ascending, each as often as it occurs.

    The vector is built inside the row that holds the tokens, so embedding
    costs no shuffle, and equal neighbours make it short when stored.
    """
    return F.sort_array(F.transform(words, lambda token: token_bucket(token, dim)))


def term_frequencies(vector: Column) -> Column:
    """``array<struct(bucket, tf)>`` of a hashed vector."""

    def runs(hashed: Column) -> Column:
        n = F.size(hashed)
        is_edge = lambda i: (i == 0) | (i == n) | (hashed[i] != hashed[i - 1])
        return let(
            F.filter(F.sequence(F.lit(0), n), is_edge),
            lambda edges: F.transform(
                F.slice(edges, F.lit(1), F.size(edges) - 1),
                lambda start, i: F.struct(
                    hashed[start].alias("bucket"), (edges[i + 1] - start).alias("tf")
                ),
            ),
        )

    return let(vector, runs)
