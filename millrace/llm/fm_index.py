"""A compressed full-text index: Burrows-Wheeler transform on a wavelet matrix, searched backwards in bulk."""

from __future__ import annotations

import numpy as np


class BitRank:
    """A packed bit vector with rank queries, answered for arrays of positions."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self._words = np.packbits(padded, bitorder="little").view("<u8")
        self._before = np.concatenate([[0], np.cumsum(np.bitwise_count(self._words))]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self._before[word] + np.bitwise_count(self._words[word] & low)


class WaveletMatrix:
    """Occurrences of a symbol before a position, in as many bit ranks as a symbol has bits."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self._levels: list[tuple[int, BitRank, int]] = []
        current = symbols
        for shift in reversed(range(max(1, int(alphabet - 1).bit_length()))):
            bits = (current >> shift) & 1
            zeros = int(len(bits) - bits.sum())
            self._levels.append((shift, BitRank(bits.astype(np.uint8)), zeros))
            current = np.concatenate([current[bits == 0], current[bits == 1]])
        self._origin = self._descend(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, rank, zeros in self._levels:
            ones = rank.ones(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def count(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbol, at) - self._origin[symbol]


def _pair_ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of ranks."""
    return np.unique(first.astype(np.int64) * (int(second.max()) + 1) + second, return_inverse=True)[1]


def _shifted(ranks: np.ndarray, by: int) -> np.ndarray:
    """Rank at each place `by` further on, 0 beyond the end (ranks moved up by one)."""
    out = np.zeros(len(ranks), np.int64)
    if by < len(ranks):
        out[: len(ranks) - by] = ranks[by:] + 1
    return out


class FMIndex:
    """Index of a sequence of symbols 1..alphabet-1 for patterns of up to `depth` symbols; 0 separates texts.

    Suffixes are ordered by their first `depth` symbols (by place among equals), which backward search
    for patterns of that length needs no more than. Of the suffix array only the first entry of each
    group of equal prefixes is kept: the earliest place of that prefix.
    """

    def __init__(self, text: np.ndarray, alphabet: int, depth: int) -> None:
        self.depth = depth
        text = np.append(text, 0)  # so that no pattern reaches from the end round to the beginning
        by_length, length = {1: text.astype(np.int64)}, 1
        while length * 2 <= depth:
            by_length[length * 2] = _pair_ranks(by_length[length], _shifted(by_length[length], length))
            length *= 2

        def prefix_ranks(size: int) -> np.ndarray:
            if size in by_length:
                return by_length[size]
            half = max(k for k in by_length if k <= size)
            return _pair_ranks(by_length[half], _shifted(by_length[half], size - half))

        ranks = prefix_ranks(depth)
        order = np.argsort(ranks, kind="stable")
        self._wavelet = WaveletMatrix(text[order - 1], alphabet)  # the symbol before each suffix
        self._smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        # Where groups of suffixes begin that agree in `depth` and in `depth - 1` symbols.
        sorted_ranks = ranks[order]
        full = np.concatenate([[True], sorted_ranks[1:] != sorted_ranks[:-1]])
        self._full = BitRank(full.astype(np.uint8))
        self._earliest = order[full]
        parent = prefix_ranks(depth - 1)[order] if depth > 1 else np.zeros(len(text), np.int64)
        wide = np.concatenate([[True], parent[1:] != parent[:-1]])
        self._wide = BitRank(wide.astype(np.uint8))
        self._wide_starts = np.append(np.flatnonzero(wide), len(text))
        self._size = len(text)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: intervals of symbol + pattern from those of the patterns."""
        both = self._wavelet.count(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self._smaller[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]

    def shorten(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns of full depth without their last symbol; empty ones stay empty."""
        group = self._wide.ones(np.minimum(lo, self._size - 1) + 1) - 1
        found = hi > lo
        return np.where(found, self._wide_starts[group], lo), np.where(found, self._wide_starts[group + 1], lo)

    def earliest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Earliest place of each pattern of full depth, -1 where it does not occur."""
        found = hi > lo
        group = self._full.ones(np.minimum(lo, self._size - 1) + 1) - 1
        return np.where(found, self._earliest[np.maximum(group, 0)], -1)

    def stream(self, text: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Matching statistics, cut at `depth`, of many documents at once: where does each window occur first?

        Document k is `text[starts[k] : starts[k] + windows[k] + depth - 1]`, with symbols that the index lacks
        given as -1. It is read from its end: the interval of a window loses its last symbol and gains
        the one before it. Returns the earliest place of every window, document after document, and
        -1 for windows of which less than `depth` symbols match.
        """
        order = np.argsort(-windows, kind="stable")
        starts, windows = starts[order], windows[order]
        first = np.concatenate([[0], np.cumsum(windows)])
        out = np.full(first[-1], -1, np.int64)
        end = starts + windows + self.depth - 1
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self._size, np.int64)

        def step(lo: np.ndarray, hi: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            symbol = text[place].astype(np.int64)
            new_lo, new_hi = self.extend(lo, hi, np.maximum(symbol, 0))
            return new_lo, np.where(symbol < 0, new_lo, new_hi)

        for k in range(1, self.depth + 1):
            lo, hi = step(lo, hi, end - k)
        for back in range(int(windows.max()) if len(windows) else 0):
            active = int(np.searchsorted(-windows, -back, side="left"))
            lo, hi = lo[:active], hi[:active]
            if back:
                lost = np.flatnonzero(hi <= lo)
                lo, hi = step(*self.shorten(lo, hi), end[:active] - self.depth - back)
                if len(lost):  # a window that failed leaves no interval to shorten: search the next one anew
                    a, b = np.zeros(len(lost), np.int64), np.full(len(lost), self._size, np.int64)
                    for k in range(1, self.depth + 1):
                        a, b = step(a, b, end[:active][lost] - back - k)
                    lo[lost], hi[lost] = a, b
            out[first[:active] + windows[:active] - 1 - back] = self.earliest(lo, hi)
        # Back to the order in which the documents were given.
        counts = np.zeros(len(order), np.int64)
        counts[order] = windows
        target = np.cumsum(counts) - counts
        result = np.empty_like(out)
        result[np.repeat(target[order] - first[:-1], windows) + np.arange(len(out))] = out
        return result
