"""The FM-index, the difference-cover suffix array and the token counter against plain versions."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.llm.difference_cover import earliest_prefix, suffix_array
from millrace.llm.fm_index import FMIndex, WaveletMatrix
from millrace.llm.token_counts import PairMerger


@pytest.mark.parametrize("seed", range(5))
def test_suffix_arrays(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        text = rng.integers(1, rng.integers(2, 6), rng.integers(0, 70))
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_equal_prefixes_are_neighbours():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 300).astype(np.uint8)
    places = np.arange(len(data) - 11)
    order = suffix_array(data.astype(np.int64))
    order = order[order < len(places)]
    first: dict[bytes, int] = {}
    for i in places.tolist():
        first.setdefault(data[i : i + 12].tobytes(), i)
    found = earliest_prefix(data, order, 12)
    assert found.tolist() == [first[data[i : i + 12].tobytes()] for i in order.tolist()]


def test_a_wavelet_matrix_counts_symbols():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 21, 500)
    matrix = WaveletMatrix(text, 21)
    symbol, at = rng.integers(0, 21, 200), rng.integers(0, 501, 200)
    assert matrix.count(symbol, at).tolist() == [int((text[:a] == s).sum()) for s, a in zip(symbol, at, strict=True)]


@pytest.mark.parametrize("seed", range(5))
def test_streamed_documents_meet_their_earliest_windows(seed):
    rng = np.random.default_rng(seed)
    for _ in range(30):
        depth = int(rng.integers(1, 9))
        text = rng.integers(1, 4, rng.integers(depth, 80))
        index = FMIndex(text, 4, depth)
        docs, starts, windows = [], [], []
        for _ in range(6):
            size = int(rng.integers(depth, depth + 10))
            doc = rng.integers(1, 4, size) if rng.random() < 0.5 else np.resize(text[int(rng.integers(0, len(text))) :], size)
            doc = np.where(rng.random(size) < 0.05, -1, doc)  # symbols that the index lacks
            starts.append(sum(map(len, docs)))
            docs.append(doc)
            windows.append(size - depth + 1)
        found = index.stream(np.concatenate(docs), np.array(starts), np.array(windows))
        plain = text.tolist()
        expected = [
            next((j for j in range(len(plain) - depth + 1) if plain[j : j + depth] == doc[i : i + depth].tolist()), -1)
            for doc in docs
            for i in range(len(doc) - depth + 1)
        ]
        assert found.tolist() == expected


def test_pairs_merge_by_rank_then_from_the_left():
    merger = PairMerger({"a": 0.0, "b": 0.0, "ab": -1.0, "ba": -2.0, "aba": -3.0, "aa": -1.0})
    assert merger.count("") == 0
    assert merger.count("abab") == 2
    assert merger.count("aaa") == 2
    assert merger.count("aba") == 1
    assert merger.count("aé") == 3  # an unknown letter counts its bytes
