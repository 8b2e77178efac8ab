"""Suffix arrays by the difference-cover algorithm, and groups of equal prefixes.

Suffixes at places not divisible by 3 are the sample: their triples are sorted and named, and if names repeat
the string of names is sorted by recursion. The other suffixes are sorted by their first symbol and
the rank of the sample suffix after it, and merged with the sample.
"""

from __future__ import annotations

import numpy as np


def _packed(*columns: tuple[np.ndarray, int]) -> np.ndarray:
    """One integer per row, in the rows' order; each column has numbers from 0 to below the bound beside it."""
    key, top = columns[0][0].astype(np.int64), columns[0][1]
    for column, size in columns[1:]:
        if top * size >= 2**63:
            values, key = np.unique(key, return_inverse=True)
            top = len(values)
        key *= size
        key += column
        top *= size
    return key


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start places of all suffixes of `text` (positive integers) in ascending order."""
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    if text.max() >= 2**30:
        text = np.unique(text, return_inverse=True)[1] + 1
    symbols = int(text.max()) + 1
    s = np.zeros(n + 4, np.int32 if n < 2**30 else np.int64)  # short numbers, to stay in the processor's cache
    s[:n] = text
    # If the last place is divisible by 3, an empty suffix joins the sample to mark the end of its half.
    ones, twos = len(range(1, n + (n % 3 == 1), 3)), len(range(2, n, 3))
    triple = [np.concatenate([s[1 + k :: 3][:ones], s[2 + k :: 3][:twos]]) for k in range(3)]
    key = _packed(*((column, symbols) for column in triple))
    order = np.argsort(key)
    key = key[order]
    name = np.empty(len(key), s.dtype)
    name[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]), dtype=s.dtype)
    if name[order[-1]] < len(key):
        order = suffix_array(name)
        name[order] = np.arange(1, len(key) + 1, dtype=s.dtype)
    ranks = len(key) + 1
    rank = np.zeros(n + 4, s.dtype)
    rank[1 : 1 + 3 * ones : 3] = name[:ones]
    rank[2 : 2 + 3 * twos : 3] = name[ones:]
    sample = np.where(order < ones, 3 * order + 1, 3 * (order - ones) + 2)
    sample = sample[sample < n]
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]

    # A suffix before a sample suffix of either kind is compared by symbols up to the next sample place.
    place = np.concatenate([one, np.arange(0, n, 3)])
    both = _packed((s[place], symbols), (rank[place + 1], ranks))
    rest = np.argsort(both[len(one) :])
    before = np.searchsorted(both[: len(one)], both[len(one) :][rest])
    rest *= 3
    place = np.concatenate([two, rest])
    both = _packed((s[place], symbols), (s[place + 1], symbols), (rank[place + 2], ranks))
    before += np.searchsorted(both[: len(two)], both[len(two) :])
    out = np.empty(n, np.int64)
    at = np.arange(len(rest)) + before
    out[at] = rest
    others = np.ones(n, bool)
    others[at] = False
    out[others] = sample
    return out


def earliest_prefix(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For places in suffix order, the least place with the same `length` bytes (8 or more), in the same order.

    `data` has at least `length` bytes from each place. Equal prefixes are neighbours, so each place is
    compared with the one before it, eight bytes at a time.
    """
    if not len(order):
        return order
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, 0, (1,))
    same = np.ones(len(order) - 1, bool)
    for at in (*range(0, length - 7, 8), length - 8):
        words = eight[order + at]
        same &= words[1:] == words[:-1]
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    return np.repeat(np.minimum.reduceat(order, begin), np.diff(np.append(begin, len(order))))
