"""Counting tokens by byte-pair merging, without emitting identifiers.

A text's symbols are a doubly linked list; a heap holds the adjacent pairs that the vocabulary can merge,
lowest rank first and leftmost first within a rank. Popping and merging until the heap is empty leaves
the tokens: initial symbols minus merges. A symbol the vocabulary lacks counts its UTF-8 bytes.

The rules are those of a BPE model file of the sentencepiece library with the identity normaliser: a
space is the letter U+2581, one of which also precedes every text that is not empty. No piece of such a
vocabulary has U+2581 after another character, so merges never cross the place before a run of
spaces, and none crosses a character that occurs in no piece. Texts are cut there, and each distinct
part is counted once per worker, by its 64-bit hash.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import blocks

MARK = "▁"
MEMO_PARTS = 4_000_000
COUNTS = "doc_id long, n_bytes long, n_tokens long"


class PairMerger:
    """Merge ranks of a vocabulary, and token counts of single strings."""

    def __init__(self, pieces: dict[str, float]) -> None:
        """`pieces` maps each piece to its score; higher scores merge first."""
        self.pieces = pieces
        self._bytes = {c: len(c.encode()) for p in pieces for c in p}

    def count(self, text: str) -> int:
        """Tokens of `text`, whose spaces are already U+2581."""
        symbols: list[str] = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        score = self.pieces.get
        heap = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if (s := score(pair)) is not None:
                heap.append((-s, i, pair))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            left, j = symbols[i], after[i]
            if not left or j >= n or left + symbols[j] != pair:
                continue  # one side has merged with another neighbour meanwhile
            symbols[i], symbols[j] = pair, ""
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                following = pair + symbols[k]
                if (s := score(following)) is not None:
                    heapq.heappush(heap, (-s, i, following))
            if (h := before[i]) >= 0:
                leading = symbols[h] + pair
                if (s := score(leading)) is not None:
                    heapq.heappush(heap, (-s, h, leading))
        unknown = sum(len(s.encode()) - 1 for s in symbols if len(s) == 1 and s not in self.pieces)
        return n - merges + unknown


def load_pieces(path: str) -> dict[str, float]:
    """Normal pieces and scores of a BPE model file; refuses models with other rules."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    model = schema.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules, trainer = model.normalizer_spec, model.trainer_spec
    if (
        trainer.model_type != 2  # BPE
        or not trainer.byte_fallback
        or rules.precompiled_charsmap
        or not rules.add_dummy_prefix
        or rules.remove_extra_whitespaces
        or trainer.treat_whitespace_as_suffix
    ):
        raise ValueError("only BPE with byte fallback, identity normaliser and a leading mark is supported")
    pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
    if any(MARK in p.lstrip(MARK) for p in pieces) or any(p.type in (4, 5) for p in model.pieces):
        raise ValueError("the vocabulary merges across word starts, or has user-defined or unused pieces")
    return pieces


class PartCounter:
    """Token counts of all texts of a block, with a memo of the parts met so far."""

    def __init__(self, path: str, memo_parts: int = MEMO_PARTS) -> None:
        self._merger = PairMerger(load_pieces(path))
        # Control characters in no piece: a part ends there, and each is one byte token.
        self._alone = np.zeros(256, dtype=bool)
        used = {c for p in self._merger.pieces for c in p}
        self._alone[[b for b in (0x09, 0x0A) if chr(b) not in used]] = True
        self._cut = self._alone.copy()
        self._cut[0x20] = True
        self._limit = memo_parts
        self._keys, self._counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self._marks: dict[int, int] = {}

    def _of_marks(self, n: int) -> int:
        if n not in self._marks:
            self._marks[n] = self._merger.count(MARK * n)
        return self._marks[n]

    def _whole(self, text: str) -> int:
        """A text with its own U+2581 characters: the rules above, without the byte-level cuts."""
        marked = MARK + text.replace(" ", MARK)
        total, begin = 0, 0
        for i in range(1, len(marked)):
            if marked[i] == MARK and marked[i - 1] != MARK:
                total += self._merger.count(marked[begin:i])
                begin = i
        return total + self._merger.count(marked[begin:])

    def _parts(self, keys: np.ndarray, parts) -> np.ndarray:
        """Counts by key; `parts(i)` gives the string of key i."""
        at = np.searchsorted(self._keys, keys)
        found = np.zeros(len(keys), bool)
        inside = at < len(self._keys)
        found[inside] = self._keys[at[inside]] == keys[inside]
        out = np.zeros(len(keys), np.int64)
        out[found] = self._counts[at[found]]
        new = np.flatnonzero(~found)
        if len(new):
            count = self._merger.count
            out[new] = [count(parts(i)) for i in new.tolist()]
            if len(self._keys) + len(new) > self._limit:
                self._keys, self._counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)
            merged = np.concatenate([self._keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self._keys = merged[order]
            self._counts = np.concatenate([self._counts, out[new].astype(np.int32)])[order]
        return out

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a block."""
        texts = len(offsets) - 1
        totals = np.zeros(texts, np.int64)
        if not len(data):
            return totals
        place = np.arange(len(data))
        cut = self._cut[data]
        text_of = np.repeat(np.arange(texts), np.diff(offsets))
        begin_of = offsets[:-1][text_of]
        # For each position: the last one at or before it that is no space, not before its text.
        solid = np.maximum.accumulate(np.where(data != 0x20, place, -1))
        first = ~cut
        first[1:] &= cut[:-1] | (text_of[1:] != text_of[:-1])
        last = ~cut
        last[:-1] &= cut[1:] | (text_of[1:] != text_of[:-1])
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        # Spaces right before each word, and one more mark where they reach back to the text's start.
        begin = begin_of[starts]
        blank_from = np.maximum(np.where(starts > 0, solid[starts - 1] + 1, 0), begin)
        marks = starts - blank_from + (blank_from == begin)
        hashes = blocks.span_hash(blocks.prefix_hash(data), starts, ends)
        keys, sample, which = np.unique(
            blocks.mix(hashes + blocks.mix(marks.astype(np.uint64))), return_index=True, return_inverse=True
        )
        raw = data.tobytes()
        counts = self._parts(
            keys, lambda i: MARK * int(marks[sample[i]]) + raw[starts[sample[i]] : ends[sample[i]]].decode()
        )
        np.add.at(totals, text_of[starts], counts[which])
        # Runs of spaces followed by no word, and texts that begin with a character standing alone.
        closing = data == 0x20
        closing[:-1] &= self._alone[data[1:]] | (text_of[1:] != text_of[:-1])
        for e in np.flatnonzero(closing).tolist():
            blank = max(int(solid[e]) + 1, int(begin_of[e]))
            totals[text_of[e]] += self._of_marks(e + 1 - blank + (blank == begin_of[e]))
        alone = self._alone[data]
        np.add.at(totals, text_of[np.flatnonzero(alone)], 1)
        filled = np.flatnonzero(np.diff(offsets) > 0)
        totals[filled[alone[offsets[filled]]]] += self._of_marks(1)
        if MARK.encode() in raw:
            for i in filled.tolist():
                own = raw[offsets[i] : offsets[i + 1]]
                if MARK.encode() in own:
                    totals[i] = self._whole(own.decode())
        return totals


@functools.cache
def part_counter(path: str) -> PartCounter:
    """One counter per worker process and file."""
    return PartCounter(path)


def _counter(path: str):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = part_counter(path)
        for batch in batches:
            for lo, hi, data, offsets in blocks.blocks(batch.column(1)):
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(counter.count(data, offsets))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens are more than `limit`.

    `docs` has `doc_id` and `text`; other columns are ignored. No token is added for begin or end, and
    special strings in a text are ordinary text. A null or empty text has no bytes and no tokens; a
    null doc_id stays null; repeated rows are counted each; an empty table gives no rows. No shuffle.
    """
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = wanted.mapInArrow(_counter(path), COUNTS)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
