"""Token ids of whole texts from a public `tokenizers` file, each distinct word encoded once per worker.

The tokenizer (`word_bpe_49k.json`) drops white space and never joins characters across it, so a text's
ids are those of its words `[^\\x20\\x09-\\x0D]+` in order. The library encodes every word that a worker
has not met before, with its default handling of special strings; the ids are kept by the word's
64-bit hash, up to `MEMO_WORDS` words, then the memo starts anew.
"""

from __future__ import annotations

import functools

import numpy as np

from millrace.llm import blocks

MEMO_WORDS = 1_000_000


class WordIds:
    """Encodes blocks of texts; holds the ids of the words met so far."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._limit = memo_words
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(0, np.uint64)
        self._slots = np.zeros(0, np.int64)
        self._first = np.zeros(0, np.int64)
        self._count = np.zeros(0, np.int32)
        self._flat = np.zeros(1 << 16, np.uint32)
        self._used = 0

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        if len(self._keys) + len(keys) > self._limit:
            self._clear()
        encoded = self._tokenizer.encode_batch_fast(words, add_special_tokens=False)
        ids = [e.ids for e in encoded]
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(count.sum())
        while self._used + total > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        self._flat[self._used : self._used + total] = np.fromiter((i for one in ids for i in one), np.uint32, total)
        first = self._used + np.cumsum(count) - count
        slots = np.arange(len(self._first), len(self._first) + len(keys))
        self._used += total
        self._first, self._count = np.concatenate([self._first, first]), np.concatenate([self._count, count])
        merged = np.concatenate([self._keys, keys])
        order = np.argsort(merged, kind="stable")
        self._keys, self._slots = merged[order], np.concatenate([self._slots, slots])[order]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self._keys, keys)
        found = np.zeros(len(keys), bool)
        inside = at < len(self._keys)
        found[inside] = self._keys[at[inside]] == keys[inside]
        return at, found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block as one array, and where each text's begin (one more entry than texts)."""
        starts, ends, before = blocks.word_bounds(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes = blocks.span_hash(blocks.prefix_hash(data), starts, ends)
        keys, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        at, found = self._find(keys)
        if not found.all():
            new = np.flatnonzero(~found)
            raw = data.tobytes()
            self._learn(keys[new], [raw[starts[i] : ends[i]].decode() for i in sample[new]])
            at, found = self._find(keys)
            if not found.all():  # the memo started anew: learn this block's other words again
                new = np.flatnonzero(~found)
                self._limit, limit = 2**62, self._limit
                self._learn(keys[new], [raw[starts[i] : ends[i]].decode() for i in sample[new]])
                self._limit = limit
                at, _ = self._find(keys)
        slots = self._slots[at][which]
        count = self._count[slots].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(count)])
        gather = np.repeat(self._first[slots] - upto[:-1], count)
        gather += np.arange(upto[-1])
        return self._flat[gather], upto[before]


@functools.cache
def word_ids(path: str) -> WordIds:
    """One encoder per worker process and file."""
    return WordIds(path)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end_id` after each text, and the new bounds."""
    texts = len(bounds) - 1
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(texts + 1)
