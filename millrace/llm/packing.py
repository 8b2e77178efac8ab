"""Packing documents into windows of a fixed number of tokens: best-fit decreasing.

A document longer than a window is first cut into full windows, each a sequence of its own. Remainders
are then placed largest first, each into the open window it fits most tightly. A segment tree over
the remaining capacities 0 to `window` finds that window in log2(window) steps.

Packing runs where the rows lie, without a shuffle: each task packs its own rows, in rounds of at most
`ROUND` remainders so that memory stays bounded whatever the partition. A round ends with few windows
that are not full, so padding stays small; it is measured in the tests.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm import blocks
from millrace.llm.word_ids import with_end, word_ids

ROUND = 200_000
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
)


class CapacityTree:
    """Segment tree over capacities 0..`window`; a leaf holds the open windows with that capacity."""

    def __init__(self, window: int) -> None:
        self._base = 1 << window.bit_length()
        self._any = [0] * (2 * self._base)
        self._open: dict[int, list[int]] = {}

    def add(self, capacity: int, item: int) -> None:
        self._open.setdefault(capacity, []).append(item)
        node = self._base + capacity
        while node:
            self._any[node] += 1
            node >>= 1

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) with the least capacity of at least `size`."""
        node = self._base + size
        if not self._any[node]:
            while node > 1 and (node & 1 or not self._any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self._base:
                node *= 2
                if not self._any[node]:
                    node += 1
        capacity = node - self._base
        while node:
            self._any[node] -= 1
            node >>= 1
        return capacity, self._open[capacity].pop()


def best_fit_decreasing(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window number and offset of each size (1 to `window`), and the number of windows. Ties by position."""
    tree, fill = CapacityTree(window), 0
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take_tightest(size)
        capacity, number = found or (window, fill)
        fill += found is None
        where[i], offset[i] = number, window - capacity
        if capacity > size:
            tree.add(capacity - size, number)
    return where, offset, fill


def cut(ids: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Per piece of at most `window` ids: text number, start in its text, length, crc32 of its ids."""
    sizes = np.diff(bounds)
    pieces = -(-sizes // window)
    text = np.repeat(np.arange(len(sizes)), pieces)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
    length = np.minimum(sizes[text] - start, window)
    begin = bounds[text] + start
    raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    crc = [zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
    return text, start, length, np.array(crc, np.int64)


def _packer(path: str, end_id: int, window: int, round_size: int):
    names = [field.split()[0].strip("`") for field in PIECES.split(", ")]

    def rows(ids, start, length, crc, total, sequence, offset) -> pa.RecordBatch:
        numbers = (start, length, crc, total, sequence, offset)
        return pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in numbers]], names)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        waiting: list[tuple] = []
        held = 0

        def place() -> pa.RecordBatch:
            nonlocal sequence, waiting, held
            doc = pa.concat_arrays([w[0] for w in waiting])
            start, length, crc, total = (np.concatenate([w[k] for w in waiting]) for k in range(1, 5))
            where, offset, windows = best_fit_decreasing(length, window)
            out = rows(doc, start, length, crc, total, sequence + where, offset)
            sequence, waiting, held = sequence + windows, [], 0
            return out

        for batch in batches:
            for lo, hi, data, offsets in blocks.blocks(batch.column(1)):
                ids, bounds = with_end(*encoder.encode(data, offsets), end_id)
                text, start, length, crc = cut(ids, bounds, window)
                doc, total = batch.column(0).slice(lo, hi - lo).take(pa.array(text)), np.diff(bounds)[text]
                full = np.flatnonzero(length == window)
                if len(full):
                    number = sequence + np.arange(len(full))
                    sequence += len(full)
                    yield rows(doc.take(pa.array(full)), start[full], length[full], crc[full], total[full], number, np.zeros(len(full), np.int64))
                rest = np.flatnonzero(length < window)
                waiting.append((doc.take(pa.array(rest)), start[rest], length[rest], crc[rest], total[rest]))
                held += len(rest)
                if held >= round_size:
                    yield place()
        if held:
            yield place()

    return pack


def pack_documents(
    docs: DataFrame, path: str, end_id: int = 2, window: int = 4096, round_size: int = ROUND
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most `window` tokens.

    `docs` has `doc_id` and `text`; other columns are ignored. A document's ids are those of the
    tokenizer at `path` and `end_id`; each id lies in exactly one piece. Columns: doc_id, start (the
    document's ids before the piece), length, ids_crc32 (of the ids as little-endian 32-bit numbers),
    doc_tokens, sequence_id (unique over all tasks) and offset in the sequence, gapless from 0.

    A null or empty text is `end_id` alone; a null doc_id stays null; repeated rows are documents of
    their own; equal lengths are placed in the order read; an empty table gives no pieces.
    """
    ids = docs.select(docs["doc_id"].cast("long"), docs["text"])
    return ids.mapInArrow(_packer(path, end_id, window, round_size), PIECES)
