"""Words of whole texts, found and hashed for a batch at once.

A word is a longest run of bytes other than space and 0x09-0x0D, with A-Z lowered. A word's hash sums a random value
of each byte times a power of an odd base (mod 2^64), then mixes the bits; the table is fixed by a seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # finding words takes some 40 times that
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE_VALUES = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of stretches of a text column of about `limit` bytes, whole texts each."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, raw[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


@dataclass(frozen=True)
class Words:
    starts: np.ndarray  # byte positions in the slice
    ends: np.ndarray
    row: np.ndarray  # row in the slice
    hashes: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    solid = ~IS_SPACE[data]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[firsts] = solid[firsts]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[lasts] = solid[lasts]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    if not len(starts):
        return Words(starts, ends, row, np.zeros(0, np.uint64))
    stretch = np.diff(np.append(starts, len(data)))
    begin = np.repeat(starts, stretch)
    place = np.arange(starts[0], len(data)) - begin
    place[~solid[starts[0]:]] = 0
    powers = np.empty(int(place.max()) + 1, dtype=np.uint64)
    powers[0] = 1
    powers[1:] = BASE
    np.cumprod(powers, out=powers)
    value = BYTE_VALUES[LOWER[data[starts[0]:]]] * powers[place]
    value[~solid[starts[0]:]] = 0
    return Words(starts, ends, row, mixed(np.add.reduceat(value, starts - starts[0])))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Of each row, its sorted distinct hashes of `width` words in a row; fewer words count as one shingle."""
    found = find_words(data, offsets)
    rows = len(offsets) - 1
    bounds = np.searchsorted(found.row, np.arange(rows + 1))
    joined = np.zeros(max(0, len(found.hashes) - width + 1), dtype=np.uint64)
    if len(joined):
        for k in range(width):
            joined = mixed(joined * BASE + found.hashes[k:k + len(joined)])
    for r in range(rows):
        low, high = bounds[r], bounds[r + 1]
        if high - low >= width:
            yield np.unique(joined[low:high - width + 1])
        elif high > low:
            whole = np.array([high - low], dtype=np.uint64)
            for k in range(low, high):
                whole = mixed(whole * BASE + found.hashes[k:k + 1])
            yield whole
        else:
            yield np.zeros(0, dtype=np.uint64)
