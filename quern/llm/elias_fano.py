"""Elias-Fano coded increasing sequences as numpy arrays, searched many values at a time."""

from __future__ import annotations

import tempfile

import numpy as np

_POP = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.uint8)
#: Place of the k-th set bit of a byte.
_PLACE = np.array([[next((b for b in range(8) if x >> b & 1 and bin(x & ((1 << b) - 1)).count("1") == k), 0) for k in range(8)] for x in range(256)], np.uint8)


def mapped(array: np.ndarray) -> np.ndarray:
    """The same array, read-only and memory-mapped from a temporary file that is gone with the process."""
    if not array.size:
        return array
    with tempfile.TemporaryFile() as file:
        array.tofile(file)
        file.flush()
        return np.memmap(file, array.dtype, "r", shape=array.shape)


class EliasFano:
    """n increasing values below ``universe``: their low bits packed, their high bits in unary."""

    def __init__(self, values: np.ndarray, universe: int):
        values = np.asarray(values, np.uint64)
        self.n = n = int(values.size)
        self.low_bits = min(56, max(0, (max(1, universe) // max(1, n)).bit_length() - 1))
        low = values & np.uint64((1 << self.low_bits) - 1)
        packed = np.zeros((n * self.low_bits + 7) // 8 + 9, np.uint8)
        at = np.arange(n, dtype=np.int64) * self.low_bits
        for byte in range(8):
            # A value of l bits that begins inside a byte touches at most eight bytes (l <= 56).
            shifted = (low << (at & 7).astype(np.uint64)) >> np.uint64(8 * byte) & np.uint64(0xFF)
            np.bitwise_or.at(packed, (at >> 3) + byte, shifted.astype(np.uint8))
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        self.buckets = int(high[-1]) + 1 if n else 0
        bits = np.zeros(-(-(n + self.buckets + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        self.upper = mapped(np.packbits(bits, bitorder="little"))
        zeros = 64 - np.bitwise_count(np.asarray(self.upper).view("<u8")).astype(np.int64)
        self.zeros = mapped(np.cumsum(zeros) - zeros)
        self.lower = mapped(packed)

    @property
    def nbytes(self) -> int:
        return self.upper.nbytes + self.zeros.nbytes + self.lower.nbytes

    def _ends(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most ``bucket``: by the place of that zero in the upper bits."""
        word = np.searchsorted(self.zeros, bucket, side="right") - 1
        left = bucket - self.zeros[word]
        octets = ~np.asarray(self.upper).reshape(-1, 8)[word]
        seen = np.cumsum(_POP[octets], axis=1, dtype=np.int64)
        which = (seen <= left[:, None]).sum(axis=1)
        row = np.arange(word.size)
        left -= np.where(which > 0, seen[row, which - 1], 0)
        place = word * 64 + which * 8 + _PLACE[octets[row, which], left]
        return place - bucket

    def low(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.low_bits
        eight = np.ndarray((self.lower.size - 7,), "<u8", np.asarray(self.lower), 0, (1,))[bit >> 3]
        return eight >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The values at these places: high bits by the place of the set bit, low bits from the packed array."""
        places = np.asarray(places, np.int64)
        ones = self._ones()
        word = np.searchsorted(ones, places, side="right") - 1
        left = places - ones[word]
        octets = np.asarray(self.upper).reshape(-1, 8)[word]
        seen = np.cumsum(_POP[octets], axis=1, dtype=np.int64)
        which = (seen <= left[:, None]).sum(axis=1)
        row = np.arange(word.size)
        left -= np.where(which > 0, seen[row, which - 1], 0)
        high = word * 64 + which * 8 + _PLACE[octets[row, which], left] - places
        return high.astype(np.uint64) << np.uint64(self.low_bits) | self.low(places)

    def _ones(self) -> np.ndarray:
        """Set bits before each word of the upper part: all its bits less the unset ones."""
        return np.arange(self.zeros.size, dtype=np.int64) * 64 - self.zeros

    def successor_within(self, lo: np.ndarray, hi: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value not below each of ``values`` among the places from ``lo`` to before ``hi``, and whether
        it is equal."""
        lo, end, values = np.array(lo, np.int64), np.asarray(hi, np.int64), np.asarray(values, np.uint64)
        hi = end.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) >> 1
            below = self.at(middle) < values[open_]
            lo[open_[below]] = middle[below] + 1
            hi[open_[~below]] = middle[~below]
        inside = np.flatnonzero(lo < end)
        equal = np.zeros(values.size, bool)
        equal[inside] = self.at(lo[inside]) == values[inside]
        return lo, equal

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value not below each of ``values``, and whether it is equal."""
        values = np.asarray(values, np.uint64)
        if not self.n or not values.size:
            return np.zeros(values.size, np.int64), np.zeros(values.size, bool)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        beyond = high >= self.buckets
        high = np.where(beyond, self.buckets - 1, high)
        end = self._ends(high)
        lo = np.where(high > 0, self._ends(np.maximum(0, high - 1)), 0)
        last = end
        want = values & np.uint64((1 << self.low_bits) - 1)
        hi = end.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) >> 1
            below = self.low(middle) < want[open_]
            lo[open_[below]] = middle[below] + 1
            hi[open_[~below]] = middle[~below]
        inside = (lo < last) & ~beyond
        equal = np.zeros(values.size, bool)
        equal[inside] = self.low(lo[inside]) == want[inside]
        return np.where(beyond, self.n, lo), equal
