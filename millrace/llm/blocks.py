"""Texts of an Arrow batch as byte blocks, and word boundaries and hashes on them, vectorised.

Helpers used inside tasks. A block is some consecutive texts laid end to end in one uint8 array, with
`offsets[i]:offsets[i + 1]` the bytes of text i; null texts count as empty. Words are runs of bytes
outside `[\\x20\\x09-\\x0D]`, and never reach from one text into the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Multiplier and byte values of the polynomial hash modulo 2**64 (arbitrary odd and random numbers).
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    column = column.cast(pa.large_string()).cast(wide) if not pa.types.is_binary(column.type) else column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if buffers[2] is None:
        return np.zeros(0, np.uint8), offsets
    return np.frombuffer(buffers[2], dtype=np.uint8), offsets


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of blocks of about `size` bytes; a text is never cut."""
    data, offsets = texts_of(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each text (one more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _ladder(base: int, n: int) -> np.ndarray:
    """The first `n` powers modulo 2**64."""
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64, out=steps)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """`n` powers and inverse powers at least. Those of one block stay; a longer text has its own, for a while."""
    global _powers, _inverses
    if n > BLOCK_BYTES + 1:
        return _ladder(_BASE, n), _ladder(pow(_BASE, -1, 2**64), n)
    if len(_powers) < n:
        _powers, _inverses = _ladder(_BASE, BLOCK_BYTES + 1), _ladder(pow(_BASE, -1, 2**64), BLOCK_BYTES + 1)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial sums before each position, for `span_hash`."""
    return prefix_sums(_VALUES[data])


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """The same for any sequence of 64-bit values."""
    powers, _ = _tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[: len(values)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans `starts[i]:ends[i]`; equal bytes have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix((sums[ends] - sums[starts]) * _tables(len(sums))[1][starts])


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every `n` consecutive word hashes; entry i covers words i to i + n - 1."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total, factor = np.zeros(len(words) - n + 1, np.uint64), np.uint64(0xA24BAED4963EE407)
    for k in range(n):
        total = total * factor + words[k : len(words) - n + 1 + k]
    return mix(total)
