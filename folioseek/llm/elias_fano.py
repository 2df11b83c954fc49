"""Elias-Fano coded sequences, searched for many values at once.

A sequence of ``n`` rising integers is cut into low bits, packed, and high
bits, written in unary into one bit vector. Both are plain arrays, so a file
that holds them can be mapped into memory and searched as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK_WORDS = 8
BLOCK_BITS = 64 * BLOCK_WORDS
# Steps of a search that guess; after so many, nearly all values are found.
EVEN_STEPS = 5
LONG_RUN = 4
_CUTS = np.arange(1, 8, dtype=np.int64)
# The place of the k-th one in a byte, at 8 times the byte and k.
_PLACE = np.zeros((256, 8), dtype=np.int64)
for _byte in range(256):
    _ones = np.flatnonzero((_byte >> np.arange(8)) & 1)
    _PLACE[_byte, : len(_ones)] = _ones
_PLACE = _PLACE.reshape(-1)
_U = np.uint64
# Every second bit, every second pair, half of every byte, the lowest and the highest bit of every byte.
_PAIRS, _FOURS, _HALVES, _LOWEST, _HIGHEST = (_U(int(digits * 8, 16)) for digits in ("55", "33", "0f", "01", "80"))
# The lowest and the highest bit of seven fields of 9 bits, and the bits before the second to eighth word of a block in them.
_STEPS, _TOPS, _BEFORE = (_U(sum(field(i) << (9 * i) for i in range(7))) for field in (lambda i: 1, lambda i: 256, lambda i: 64 * i + 64))


@dataclass
class Monotone:
    """``n`` rising integers: ``bits`` for the high parts, ``low`` of ``width`` bits each. ``distinct`` says that none repeats.

    ``ones`` counts those before each block, ``inner`` those of a block before its second to eighth word, in 9 bits each.
    """

    n: int
    width: int
    bits: np.ndarray
    ones: np.ndarray
    inner: np.ndarray
    low: np.ndarray
    distinct: bool = False

    def __post_init__(self):
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * BLOCK_BITS - self.ones

    @classmethod
    def of(cls, values: np.ndarray) -> Monotone:
        """From rising values below 2**63."""
        values = values.astype(np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, ((top + 1) // max(1, n)).bit_length() - 1)
        high = values >> width
        size = n + (top >> width) + 2
        blocks = -(-size // BLOCK_BITS)
        marks = np.zeros(blocks * BLOCK_BITS, dtype=np.uint8)
        marks[high + np.arange(n)] = 1
        bits = np.packbits(marks, bitorder="little").view(np.uint64)
        within = np.cumsum(np.bitwise_count(bits.reshape(blocks, BLOCK_WORDS)), axis=1, dtype=np.int64)
        ones = np.concatenate([[0], np.cumsum(within[:, -1])])[:-1]
        inner = np.bitwise_or.reduce(within[:, :-1].astype(np.uint64) << (np.arange(BLOCK_WORDS - 1, dtype=np.uint64) * _U(9)), axis=1)
        low = np.zeros(n * width // 64 + 2, dtype=np.uint64)
        if width:
            part = (values & ((1 << width) - 1)).astype(np.uint64)
            at = np.arange(n, dtype=np.int64) * width
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, part << shift)
            over = (at & 63) + width > 64
            np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (_U(64) - shift[over]))
        return cls(n, width, bits, ones.astype(np.int64), inner, low)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"bits": self.bits, "ones": self.ones, "inner": self.inner, "low": self.low}

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Where the k-th one, or zero, stands."""
        before = self.ones if ones else self.zeros
        block = np.searchsorted(before, k, side="right") - 1
        rest = (k - before[block]).view(np.uint64)
        inner = self.inner[block]
        if not ones:
            inner = _BEFORE - inner
        # How many of the seven counts are not beyond ``rest``, all compared in one word; the last of these has been passed.
        wanted = rest * _STEPS
        beyond = (((wanted | _TOPS) - (inner & ~_TOPS)) | (wanted ^ inner)) ^ (inner & ~wanted)
        word = np.bitwise_count(beyond & _TOPS).view(np.int8).astype(np.int64)
        rest -= (inner >> np.where(word > 0, word * 9 - 9, 63).view(np.uint64)) & _U(511)
        word += block * BLOCK_WORDS
        bits = self.bits[word] if ones else ~self.bits[word]
        # The ones up to the end of each byte, all in one word, and how many of these are not beyond ``rest``.
        sums = bits - ((bits >> _U(1)) & _PAIRS)
        sums = (sums & _FOURS) + ((sums >> _U(2)) & _FOURS)
        sums = ((sums + (sums >> _U(4))) & _HALVES) * _LOWEST
        byte = np.minimum(np.bitwise_count((((rest * _LOWEST) | _HIGHEST) - sums) & _HIGHEST), 7).astype(np.uint64) << _U(3)
        rest -= ((sums << _U(8)) >> byte) & _U(255)
        place = _PLACE[((((bits >> byte) & _U(255)) << _U(3)) | rest).view(np.int64)]
        return word * 64 + byte.view(np.int64) + place

    def _run_from(self, at: np.ndarray, ones: bool) -> np.ndarray:
        """How many ones, or zeros, stand in a row from a place on, up to 64."""
        word, shift = at >> 6, (at & 63).view(np.uint64)
        following = self.bits[np.minimum(word + 1, len(self.bits) - 1)]
        ends = (self.bits[word] >> shift) | (following << (_U(63) - shift) << _U(1))
        if ones:
            ends = ~ends
        return np.bitwise_count((ends & (~ends + _U(1))) - _U(1)).astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=np.int64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).view(np.uint64)
        value = self.low[word] >> shift
        value |= self.low[word + 1] << (_U(63) - shift) << _U(1)
        return (value & _U((1 << self.width) - 1)).view(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``, all of them in the sequence."""
        high = self._select(i, True) - i
        return (high << self.width) | self._low(i)

    def spans(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places ``i`` and ``i + 1``, all of them in the sequence."""
        one = self._select(i, True)
        run = self._run_from(one + 1, False)
        next_ = one + 1 + run
        # The next one is beyond the window.
        far = np.flatnonzero(run == 64)
        if len(far):
            next_[far] = self._select(i[far] + 1, True)
        return ((one - i) << self.width) | self._low(i), ((next_ - i - 1) << self.width) | self._low(i + 1)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1; values that occur more than once have their first place."""
        result = np.full(len(values), -1, dtype=np.int64)
        if not self.n or not len(values):
            return result
        high = values >> self.width
        # Beyond the zeros of the bit vector no value has this high part.
        within = np.flatnonzero((values >= 0) & (high < len(self.bits) * 64 - self.n - 1))
        values, high = values[within], high[within]
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1, 0)
        end = begin + self._run_from(begin, True)
        # A run of ones that fills the window may go on; its end is the next zero.
        long = np.flatnonzero(end - begin == 64)
        if len(long):
            end[long] = self._select(high[long], False)
        low, stop = begin - high, end - high
        open_ = np.flatnonzero(low < stop)
        low, stop, wanted = low[open_], stop[open_], (values & ((1 << self.width) - 1))[open_]
        places = within[open_]
        # The first steps take the low bits between two that are known for even; where a long run ends is looked up before.
        least, beyond = np.zeros(len(places), dtype=np.int64), np.full(len(places), 1 << self.width, dtype=np.int64)
        long = np.flatnonzero(stop - low > LONG_RUN)
        beyond[long] = np.maximum(self._low(stop[long] - 1), wanted[long]) + 1
        for _ in range(EVEN_STEPS):
            middle = np.minimum(low + ((wanted - least) / (beyond - least) * (stop - low)).astype(np.int64), stop - 1)
            value = self._low(middle)
            equal = value == wanted
            hit = np.flatnonzero(equal)
            result[places[hit]] = middle[hit]
            less = value < wanted
            low, stop = np.where(less, middle + 1, low), np.where(less, stop, middle)
            # Values that rise have one place; of others the first one may be still to come.
            more = np.flatnonzero((low < stop) & ~equal if self.distinct else low < stop)
            value, less = value[more] + 1, less[more]
            least, beyond = np.where(less, value, least[more]), np.where(less, beyond[more], value)
            low, stop, wanted, places = low[more], stop[more], wanted[more], places[more]
        # The others cut what is left into pieces, so that the last few are not looked for in many steps.
        while len(places):
            cuts = low[:, None] + (stop - low)[:, None] * _CUTS // (len(_CUTS) + 1)
            value = self._low(cuts.reshape(-1)).reshape(cuts.shape)
            less = np.count_nonzero(value < wanted[:, None], axis=1)
            row, next_ = np.arange(len(places)), np.minimum(less, len(_CUTS) - 1)
            equal = value[row, next_] == wanted
            hit = np.flatnonzero(equal)
            result[places[hit]] = cuts[hit, next_[hit]]
            low, stop = np.where(less > 0, cuts[row, less - 1] + 1, low), np.where(less < len(_CUTS), cuts[row, next_], stop)
            more = np.flatnonzero((low < stop) & ~equal if self.distinct else low < stop)
            low, stop, wanted, places = low[more], stop[more], wanted[more], places[more]
        return result
