"""Vectorised helpers over the UTF-8 buffers of Arrow string columns.

They run inside Spark tasks (``mapInArrow``): no Python string is made for a
word, so the cost follows the bytes of the text, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: ASCII letters A-Z to lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that belong to a word: all but space and 0x09-0x0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes that belong to a word after lower-casing: digits, a-z and all of 0x80-0xFF.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_LONG = 256


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text, or one row if a text is longer."""
    if not batch.num_rows:
        return
    _, offsets = buffer(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and the n + 1 offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of bytes with ``inside`` set; runs end with their text."""
    if not data.size:
        return (np.zeros(0, np.int64),) * 3
    w = inside[data]
    first, last = offsets[:-1], offsets[1:]
    some = last > first
    before = np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    before[first[some]] = False
    after = np.empty_like(w)
    after[-1], after[:-1] = False, w[1:]
    after[last[some] - 1] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs, eight bytes a round, equal for equal bytes wherever they stand."""
    if not starts.size:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((padded.size - 7,), "<u8", padded, 0, (1,))
    sizes = ends - starts
    h = mixed(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    h = mixed(h ^ (eights[starts] & _MASK[np.minimum(sizes, 8)]))
    left = np.flatnonzero((sizes > 8) & (sizes <= _LONG))
    at = 8
    while left.size:
        rest = sizes[left] - at
        h[left] = mixed(h[left] ^ (eights[starts[left] + at] & _MASK[np.minimum(rest, 8)]))
        left, at = left[rest > 8], at + 8
    for i in np.flatnonzero(sizes > _LONG):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    return h


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs copied end to end with one space after each: bytes, and each run's start and end there."""
    sizes = ends - starts
    to = np.cumsum(sizes + 1) - (sizes + 1)
    out = np.full(int(sizes.sum()) + sizes.size, 0x20, np.uint8)
    shift = np.repeat(to - starts, sizes)
    place = np.arange(shift.size, dtype=np.int64) + np.repeat(to - (np.cumsum(sizes) - sizes), sizes)
    out[place] = data[place - shift]
    return out, to, to + sizes
