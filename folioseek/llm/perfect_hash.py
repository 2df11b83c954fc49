"""Minimal perfect hashing of 64-bit keys by levels of bit arrays.

On each level a key takes one place of an array of about two bits a key. Keys
that are alone at their place set its bit; the others go on to the next level.
The hash of a key is the number of set bits before its own, over all levels:
``n`` keys get the numbers 0 to ``n - 1``, with some three bits a key stored.
A key outside the set may get a number too, so callers keep the keys in the
order of their numbers and compare.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from folioseek.llm.common import mixed

BITS_PER_KEY = 2


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = mixed(np.array([level + 1], dtype=np.uint64))
    return (mixed(keys.view(np.uint64) + seed) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> list[bytes]:
    """The bit array of each level for different 64-bit keys."""
    levels, rest = [], np.ascontiguousarray(keys, dtype=np.int64)
    while len(rest):
        size = 8 * (-(-BITS_PER_KEY * len(rest) // 8))
        places = _places(rest, len(levels), size)
        alone = np.bincount(places, minlength=size) == 1
        levels.append(np.packbits(alone).tobytes())
        rest = rest[~alone[places]]
    return levels


class PerfectHash:
    """Numbers of keys, from the levels that ``build`` made."""

    def __init__(self, levels: Sequence[bytes]) -> None:
        self.bits = [np.unpackbits(np.frombuffer(level, dtype=np.uint8)).view(bool) for level in levels]
        self.before, total = [], 0
        for bits in self.bits:
            ranks = np.cumsum(bits)
            self.before.append(ranks + (total - 1))
            total += int(ranks[-1])
        self.size = total

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for some keys outside the set, any number for others."""
        found = np.full(len(keys), -1, dtype=np.int64)
        rest = np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.bits, self.before, strict=True)):
            places = _places(np.ascontiguousarray(keys[rest], dtype=np.int64), level, len(bits))
            hit = bits[places]
            found[rest[hit]] = before[places[hit]]
            rest = rest[~hit]
        return found
