"""Suffix deduplication hashes texts in small blocks, and its suffix sort takes symbols of any size."""

from __future__ import annotations

import dataclasses
import random

import numpy as np

from millrace.llm import repeats, suffixes
from millrace.llm.difference_cover import suffix_array
from tests.llm import fixtures


def test_suffix_arrays_of_large_symbols():
    rng = np.random.default_rng(4)
    for bits in (20, 29, 30, 31, 40, 60, 62):
        text = rng.integers(2**bits, 2**bits + 2 ** (bits - 1), 200)
        text = np.concatenate([text, text[50:150]])
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_texts_are_hashed_in_small_blocks(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(200))
    texts = [(i, "".join(rng.choice("abcdefgh ") for _ in range(1500)) + passage[: rng.randint(0, 200)]) for i in range(200)]
    texts += [(1000 + i, texts[i][1][300:]) for i in range(0, 200, 7)]
    own = suffixes.rules(50)

    def symbols(data, offsets):
        if len(data) > 128 << 10:
            raise ValueError(f"{len(data)} bytes at a time")
        return own.symbols(data, offsets)

    docs = spark.createDataFrame(fixtures.rows(texts), fixtures.SCHEMA).coalesce(1)
    found = repeats.repeat_results(docs, dataclasses.replace(own, symbols=symbols)).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == fixtures.kept_bytes(texts, 50)
