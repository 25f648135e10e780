"""Words, word hashes and window hashes of whole Arrow batches, without a Python loop over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_LONG_WORD = 32
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(
    column: pa.Array, limit: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) for runs of rows of about `limit` bytes.

    A longer text makes a run of its own. A null is an empty text.
    """
    rows = len(column)
    if not rows:
        return
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    low = 0
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(rows, max(high, low + 1))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def word_spans(
    data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the total) of the runs outside `space`."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    gap = space[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, gap[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, gap[1:]
    after[inner[inner > 0] - 1] = True
    word = ~gap
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; eight bytes at a time, long words one by one."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    first = eights[starts] & _MASKS[np.minimum(length, 8)]
    hashes = mixed(first + length.astype(np.uint64) * np.uint64(_BASES[0]))
    for at in range(8, _LONG_WORD, 8):
        more = np.flatnonzero(length > at)
        if not len(more):
            break
        part = eights[starts[more] + at] & _MASKS[np.minimum(length[more] - at, 8)]
        hashes[more] = mixed(hashes[more] * np.uint64(_BASES[1]) + part)
    for i in np.flatnonzero(length > _LONG_WORD):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return hashes


_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, length: int) -> np.ndarray:
    known = _powers.get((base, 0))
    if known is None or len(known) < length:
        values = np.full(max(length, 1 << 16), base, np.uint64)
        values[0] = 1
        known = _powers[base, 0] = np.cumprod(values)
    return known[:length]


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `size` words; rows are not told apart.

    Hashes are compared across rows and batches, so they depend on the words alone.
    """
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    if seed:
        words = mixed(words ^ np.uint64(_BASES[seed]))
    base = _BASES[seed] | 1
    inverse = pow(base, -1, 1 << 64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power(base, len(words)), out=sums[1:])
    return mixed((sums[size:] - sums[:count]) * _power(inverse, count))


def starts_in_rows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, row, position in the row) of every window of `size` words that lies in one row."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    position = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[row] + position, row, position
