"""Suffix-array deduplication on bytes: difference-cover suffix sorting per shard, adjacent prefixes compared."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import blocks
from millrace.llm.difference_cover import earliest_prefix, suffix_array
from millrace.llm.repeats import Rules, compressed, repeat_results, restored

GRAM = 16
#: Eight bytes a byte of text are held in each step of hashing; that many stay in a core's own cache.
BLOCK = 128 << 10
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rolled, span = data.astype(np.uint64) + np.uint64(1), 1
    for factor in _FACTORS:  # hashes of 2, 4, 8 and 16 bytes
        if len(rolled) <= span:
            rolled = rolled[:0]
            break
        rolled = rolled[:-span] * factor + rolled[span:]
        rolled ^= rolled >> np.uint64(29)
        span *= 2
    return data, blocks.mix(rolled), offsets


def earliest_windows(data: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Where each window of the given byte strings starts first, from the suffix array of them all."""
    ends = np.cumsum(windows + length - 1)
    text = np.insert(data.astype(np.int16) + 2, ends, 1)  # 1 ends a string and is in no window
    shift = np.repeat(np.arange(len(starts)), windows)
    index = np.arange(len(shift))
    places = (starts - np.cumsum(windows) + windows)[shift] + index + shift
    slot = np.full(len(text), -1, np.int64)
    slot[places] = index
    order = suffix_array(text)
    order = order[slot[order] >= 0]
    # Compared without the marks: no window holds one.
    plain = order - shift[slot[order]]
    out = np.empty(len(shift), np.int64)
    out[slot[order]] = earliest_prefix(data, plain, length)
    return out


def _result(data: np.ndarray, offsets: np.ndarray, removed: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    raw, kept = data.tobytes(), ~removed
    gone = np.concatenate([[0], np.cumsum(removed)])[offsets]
    begins = removed.copy()
    begins[1:] &= ~removed[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    begins[at] = removed[at]
    spans = np.concatenate([[0], np.cumsum(begins)])[offsets]
    shas = []
    for i in range(len(offsets) - 1):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        own = raw[lo:hi] if gone[i + 1] == gone[i] else data[lo:hi][kept[lo:hi]].tobytes()
        shas.append(hashlib.sha256(own).hexdigest())
    columns = (np.diff(offsets), np.diff(gone), np.diff(spans))
    return [*map(pa.array, columns), pa.array(shas, pa.string())]


def rules(length: int = 50) -> Rules:
    if length < GRAM:
        raise ValueError(f"strings must have at least {GRAM} bytes")
    return Rules(
        window=length,
        gram=GRAM,
        symbols=_symbols,
        pack=lambda data: compressed(data.tobytes()),
        unpack=lambda data: np.frombuffer(restored(data), np.uint8),
        earliest=lambda data, starts, windows: earliest_windows(data, starts, windows, length),
        within_document=False,
        result=_result,
        result_schema="n_bytes long, n_removed long, n_spans long, kept_sha256 string",
        block=BLOCK,
    )


def remove_repeated_bytes(docs: DataFrame, length: int = 50) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts in a document with a smaller doc_id.

    `docs` has `doc_id` and `text`; other columns are ignored. Texts are UTF-8 bytes, strings are judged on the
    input, overlaps count, and matches never cross texts. Returns per row doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs) and kept_sha256, the lowercase hex digest of the remaining bytes end to
    end. A null or empty text has no bytes. Rows without doc_id come after all others; rows that
    repeat a doc_id do not remove each other's bytes. An empty table gives no rows.

    Within a shard (see `repeats`) the distinct runs of bytes are one string, whose suffix array comes from the
    difference-cover algorithm; neighbours in it are compared on their first `length` bytes.
    """
    return repeat_results(docs, rules(length))
