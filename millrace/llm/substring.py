"""Substring deduplication on words: an FM-index per shard, searched backwards with streamed documents."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import blocks
from millrace.llm.fm_index import FMIndex
from millrace.llm.repeats import Rules, compressed, repeat_results, restored

GRAM = 6


def _symbols(gram: int):
    def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, before = blocks.word_bounds(data, offsets)
        words = blocks.span_hash(blocks.prefix_hash(data), starts, ends)
        return words, blocks.gram_hash(words, gram), before

    return symbols


def _pack(words: np.ndarray) -> bytes:
    distinct, which = np.unique(words, return_inverse=True)
    return compressed(len(distinct).to_bytes(8, "little") + distinct.tobytes() + which.astype(np.uint32).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = restored(data)
    count = int.from_bytes(raw[:8], "little")
    distinct = np.frombuffer(raw, np.uint64, count, 8)
    return distinct[np.frombuffer(raw, np.uint32, -1, 8 + 8 * count)]


def earliest_windows(words: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Where each window of the given documents starts first in their text, by an FM-index of it."""
    distinct, which = np.unique(words, return_inverse=True)
    sizes = windows + length - 1
    ends = np.cumsum(sizes)
    text = np.insert(which + 1, ends, 0)
    shift = np.arange(len(starts))
    index = FMIndex(text, len(distinct) + 1, length)
    found = index.stream(text, starts + shift, windows)
    return found - np.searchsorted(ends + shift, found)


def _result(data: np.ndarray, offsets: np.ndarray, removed: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    raw, kept, shas = data.tobytes(), ~removed, []
    gone = np.concatenate([[0], np.cumsum(removed)])[bounds]
    for i in range(len(offsets) - 1):
        words = raw[offsets[i] : offsets[i + 1]].split()
        if gone[i + 1] > gone[i]:
            words = compress(words, kept[bounds[i] : bounds[i + 1]].tolist())
        shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return [pa.array(np.diff(bounds)), pa.array(np.diff(gone)), pa.array(shas, pa.string())]


def rules(window: int = 20) -> Rules:
    return Rules(
        window=window,
        gram=min(GRAM, window),
        symbols=_symbols(min(GRAM, window)),
        pack=_pack,
        unpack=_unpack,
        earliest=lambda words, starts, windows: earliest_windows(words, starts, windows, window),
        within_document=True,
        result=_result,
        result_schema="n_words long, n_removed long, kept_sha256 string",
    )


def remove_repeated_words(docs: DataFrame, window: int = 20) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts earlier; judged on the input.

    `docs` has `doc_id` and `text`; other columns are ignored. Earlier means a smaller doc_id, or the same
    document and an earlier start. Words are runs outside `[\\x20\\x09-\\x0D]`, unchanged. Returns per row
    doc_id, n_words, n_removed and kept_sha256, the lowercase hex digest of the kept words joined by one
    space. A null or empty text has no words. Rows without doc_id come after all others; rows that
    repeat a doc_id are texts of one document, in order of their text. An empty table gives no rows.

    Within a shard (see `repeats`) the distinct runs of words are indexed once and streamed against the index:
    backward search over its wavelet matrix gives each window's matching statistic, cut at `window`, and
    the earliest place at which it is reached.
    """
    return repeat_results(docs, rules(window))
