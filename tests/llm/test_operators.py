"""Each operator against a plain version, on corpora with nulls, empty texts, copies and clashing columns."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import (
    components,
    exact,
    jaccard,
    leaks,
    licences,
    packing,
    quality,
    repeats,
    substring,
    suffixes,
    token_counts,
    token_files,
)
from millrace.llm.queries import vocabulary
from tests.llm import fixtures

WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def table(spark, texts):
    return spark.createDataFrame(fixtures.rows(texts), fixtures.SCHEMA).repartition(3)


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def ids_of(text, end):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary(WORDS))
    return [*own.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = [(1, "it's <|endoftext|> DON'T"), (2, "x<|startoftext|>y \x85   z"), (3, "Å Å ΣΑΣ 日本語 😀"), (4, "▁ a▁ b"), (5, " \n a  b \t"), (6, "x" * 9000)]


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    texts = fixtures.corpus(1) + ODD
    own = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    out = token_counts.token_counts(table(spark, texts), vocabulary(PIECES), limit=150)
    expected = {}
    for i, t in texts:
        n = len(own.encode(t or ""))
        expected[i] = (len((t or "").encode()), n, n > 150)
    assert by_id(out) == expected


def test_token_files_hold_every_id_in_order(spark):
    texts = fixtures.corpus(2) + ODD
    out = by_id(token_files.token_files(table(spark, texts), vocabulary(WORDS), end_id=1))
    start = 0
    for i, t in sorted(texts):
        ids = ids_of(t, 1)
        assert out[i] == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(out) == len(texts)


def test_a_shard_gives_back_any_range_of_ids(tmp_path):
    import pyarrow.fs

    store = pyarrow.fs.LocalFileSystem()
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 5, 70_000, 200_000, 1)]
    writer = token_files.ShardWriter(store.open_output_stream(str(tmp_path / "s")))
    for k, p in enumerate(parts):
        writer.add(np.array([k]), np.array([len(p)]), p)
    writer.close()
    every = np.concatenate(parts)
    reader = token_files.ShardReader(store.open_input_file(str(tmp_path / "s")))
    assert reader.counts.tolist() == [len(p) for p in parts]
    for lo, hi in [(0, 0), (0, len(every)), (65_535, 65_537), (131_072, 262_145)]:
        assert (reader.ids(lo, hi) == every[lo:hi]).all()
    cut = tmp_path / "cut"
    cut.write_bytes((tmp_path / "s").read_bytes()[:-3])
    with pytest.raises(ValueError):
        token_files.ShardReader(store.open_input_file(str(cut)))


def test_files_of_lost_tasks_are_not_read(spark, tmp_path):
    texts = fixtures.corpus(3, 20)
    token_files.write_token_files(table(spark, texts), str(tmp_path), vocabulary(WORDS))
    (tmp_path / "shards" / "00000000-lost.tok").write_bytes(b"half a shard")
    assert len(by_id(token_files.read_token_files(spark, str(tmp_path)))) == len(texts)


@pytest.mark.parametrize("window", [16, 4096])
def test_packing_places_every_id_once(spark, window):
    texts = fixtures.corpus(4) + ODD
    out = packing.pack_documents(table(spark, texts), vocabulary(WORDS), 2, window, round_size=40).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in texts:
        ids, at = ids_of(t, 2), 0
        for p in sorted(pieces[i], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == crc(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(5)
    sizes = np.array([rng.randint(1, 100) for _ in range(400)])
    where, offset, windows = packing.best_fit_decreasing(sizes, 100)
    rooms: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        able = [r for r in rooms if r >= sizes[i]]
        room = min(able, default=100)
        assert 100 - offset[i] == room
        rooms.remove(room) if able else None
        rooms.append(room - sizes[i])
    assert windows == len(rooms)
    assert sizes.sum() / (100 * windows) > 0.98


def test_padding_is_small_on_the_test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = packing.pack_documents(docs, vocabulary(WORDS))
    used, sequences = out.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert used / (4096 * sequences) > 0.99


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_duplicates_equal_plain_grouping(spark, seed):
    texts = fixtures.corpus(seed) + [(200_000, "y" * 200_000), (200_001, "y" * 200_000)]
    df = table(spark, texts)
    assert by_id(exact.exact_duplicates(df)) == fixtures.exact_groups(texts)
    stay = exact.drop_exact_duplicates(df)
    assert stay.columns == df.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(i for i, g in fixtures.exact_groups(texts).items() if g[2])


def test_exact_duplicates_of_repeated_rows_and_null_ids(spark):
    texts = [(5, "a  b"), (5, "a b"), (5, "c"), (None, "a b"), (None, None), (9, "")]
    out = exact.exact_duplicates(table(spark, texts))
    found = sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in out.collect())
    assert found == [(-1, 5, 3, False), (-1, 9, 2, False), (5, 5, 1, True), (5, 5, 3, False), (5, 5, 3, True), (9, 9, 2, True)]
    assert exact.drop_exact_duplicates(table(spark, texts)).count() == 3


def test_chunks_of_one_address_are_told_apart_by_their_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict(
        {
            "address": [7, 7, 7, 8], "chunk": [b"a", b"a", b"b", b"b"], "doc_ids": [[1], [2], [3], [4]], "shas": [[b"s"]] * 4,
            "positions": pa.array([[0]] * 4, pa.list_(pa.int32())), "copies": pa.array([[1]] * 4, pa.list_(pa.int32())),
        }
    )
    names = next(exact._verify(iter([batch]))).column("identifier").to_pylist()
    assert names[0] == names[1] and len(set(names)) == 3


@pytest.mark.parametrize("percent, words, lot", [(90, 3, 1000), (80, 5, 4), (60, 1, 3)])
def test_jaccard_components_equal_all_pairs(spark, percent, words, lot):
    texts = fixtures.corpus(percent, 80)
    out = by_id(jaccard.jaccard_components(table(spark, texts), percent, words, lot))
    assert out == fixtures.near_components(texts, percent, words)


def test_jaccard_of_null_and_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(40))
    texts = [(None, base), (3, base), (2, base + " x"), (2, "quite another text here"), (1, "quite another text here"), (8, "alone")]
    out = jaccard.jaccard_components(table(spark, texts), 80, 2).collect()
    found = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in out)
    # The two texts of document 2 bridge its groups.
    assert found == [(-1, 39, None), (1, 3, 1), (2, 3, 1), (2, 40, 1), (3, 39, 1), (8, 1, 8)]


def test_merging_by_heap_and_by_counting_agree(monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(100):
        lists = [np.unique(rng.integers(0, 30, rng.integers(0, 15))) for _ in range(rng.integers(1, 12))]
        need = int(rng.integers(1, 5))
        by_heap = jaccard.merge_short(lists, need)
        monkeypatch.setattr(jaccard, "HEAP_ENTRIES", -1)
        counted = jaccard.merge_short(lists, need)
        monkeypatch.undo()
        assert [x.tolist() for x in by_heap] == [x.tolist() for x in counted]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    out = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, out.collect())) == sorted(label.items())


@pytest.mark.parametrize("window", [3, 7, 20])
def test_repeated_words_go(spark, window):
    texts = fixtures.corpus(window, 70)
    out = by_id(substring.remove_repeated_words(table(spark, texts), window))
    assert out == fixtures.kept_words(texts, window)


@pytest.mark.parametrize("length", [16, 50])
def test_repeated_bytes_go(spark, length):
    texts = fixtures.corpus(length, 70)
    out = by_id(suffixes.remove_repeated_bytes(table(spark, texts), length))
    assert out == fixtures.kept_bytes(texts, length)


def test_substrings_of_null_and_repeated_ids(spark):
    base = " ".join(f"word{i}" for i in range(30))
    texts = [(None, base), (4, base), (4, base), (7, None)]
    found = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substring.remove_repeated_words(table(spark, texts)).collect())
    assert found == [(-1, 30, 30), (4, 30, 0), (4, 30, 30), (7, 0, 0)]
    size = len(base)
    found = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in suffixes.remove_repeated_bytes(table(spark, texts)).collect())
    assert found == [(-1, size, size), (4, size, 0), (4, size, 0), (7, 0, 0)]


@pytest.mark.parametrize("kind", ["words", "bytes"])
def test_a_passage_in_many_documents_is_dealt_to_many_tasks(spark, monkeypatch, tmp_path, kind):
    import dataclasses
    import uuid

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = " ".join(word() for _ in range(45))
    texts = [(i, " ".join([*(word() for _ in range(25)), passage, *(word() for _ in range(25))])) for i in range(600)]
    texts += [(1000 + i, texts[i][1]) for i in range(0, 600, 20)]  # whole copies repeat the ends too
    monkeypatch.setattr(repeats, "HOT_RUNS", 100, raising=False)
    own, folder = (substring.rules(20) if kind == "words" else suffixes.rules(50)), str(tmp_path)

    def earliest(symbols, starts, windows):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(starts)))
        return own.earliest(symbols, starts, windows)

    out = by_id(repeats.repeat_results(table(spark, texts), dataclasses.replace(own, earliest=earliest)))
    assert out == (fixtures.kept_words(texts, 20) if kind == "words" else fixtures.kept_bytes(texts, 50))
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert max(sizes) < 400


def test_leaks_are_found_within_the_edit_budget(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(8, 60)))) for k in range(12)] + [(50, None), (51, "too short")]
    docs = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        if i % 2:
            own = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 12)):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([["Z"], [], [own[k], "z"]])
            text[rng.randint(0, len(text)) : 0] = ["".join(own).upper() if i % 3 else "".join(own)]
        docs.append((i, rng.choice([" ", "\n"]).join(text)))
    docs += [(100, None), (101, "")]
    expected = set()
    for i, t in docs:
        plain = " ".join(fixtures.words_of(t)).translate({c: c + 32 for c in range(65, 91)}).encode()
        for k, x in items:
            index = leaks.ProbeIndex.build([x])
            best = [edit_ok for p, e in zip(index.texts, index.budgets, strict=True) if (edit_ok := fixtures.edit_distance_within(p, plain) <= e)]
            if best:
                expected.add((i, k, len(best)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 600):
        out = leaks.find_leaks(table(spark, docs), benchmark, block_bytes=size)
        assert {(r["doc_id"], r["item_id"], r["probes"]) for r in out.collect()} == expected
    left = leaks.drop_leaks(table(spark, docs), benchmark)
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in docs} - {e[0] for e in expected}


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out")
    counts = {(r["quality"], r["predicted"]): r["n"] for r in scored.groupBy("quality", "predicted").agg(F.count("*").alias("n")).collect()}
    good = counts.get((1, 1), 0) / (counts.get((1, 1), 0) + counts.get((1, 0), 0))
    bad = counts.get((0, 0), 0) / (counts.get((0, 0), 0) + counts.get((0, 1), 0))
    assert good > 0.99 and bad > 0.95


def test_held_out_labels_change_no_score(spark):
    folder = fixtures.SMALL
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    renamed = docs.withColumns({"source": F.lit("s"), "lang": F.lit(None).cast("string")})
    first = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    second = {r["doc_id"]: r["score"] for r in quality.quality_scores(renamed, flipped).collect()}
    assert first == pytest.approx(second, abs=1e-9)
    assert all(0 <= s <= 1 for s in first.values())
    expected = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in first}
    assert {r["doc_id"]: r["held_out"] for r in quality.quality_scores(docs, labels).collect()} == expected


def test_quality_without_labels_or_with_one_class(spark):
    df = table(spark, fixtures.corpus(6, 20) + [(None, "no id")])
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality_scores(df, none).collect()} == {1.0}
    ones = df.select("doc_id", F.lit(1).alias("quality"))
    assert all(r["predicted"] == 1 for r in quality.quality_scores(df, ones.union(ones)).collect())
    assert quality.keep_quality(df, ones).count() == df.count()


def test_isotonic_levels_never_fall():
    rng = np.random.default_rng(4)
    values = np.sort(rng.normal(size=200))
    labels, weights = (rng.random(200) < 0.5 + values / 6).astype(float), rng.integers(1, 5, 200).astype(float)
    knots, levels = quality.isotonic(values, labels, weights)
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
    assert np.average(np.interp(knots, knots, levels)) <= 1


def test_licences_of_lines(spark):
    wanted = {
        (1, 1): "Apache-2.0", (2, 0): "MIT", (3, 2): "GPL-3.0", (4, 0): "CC-BY-NC", (5, 0): "MIT", (6, 0): "BSD",
    }
    texts = [
        (1, "Some prose of no matter.\nLicensed under the Apache License, Version 2.0.\nMore of the same prose."),
        (2, "Released under the MIT License."),
        (3, "\n\nThis work is licensed under the GNU General Public License, version 3."),
        (4, "licensed under CC BY-NC 4.0"),
        (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (6, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
        (7, "The version of the software was released in the spring, without a warranty of good weather."),
        (8, None), (9, ""),
    ]
    docs = spark.read.parquet(f"{fixtures.SMALL}/documents.parquet")
    model = licences.fit_licences(docs)
    out = licences.find_licences(table(spark, texts), model).collect()
    assert {(r["doc_id"], r["paragraph"]): r["family"] for r in out} == wanted
    plan = licences.find_licences(table(spark, texts), model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licences_in_other_words(spark):
    wanted = [
        ("The MIT License (MIT)", "MIT"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD"), ("Distributed under the terms of the MIT license.", "MIT"),
        ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GPL-3.0"), ("MIT License", "MIT"), ("Licensed under MIT", "MIT"),
        ("This tool is distributed under the GNU Affero General Public License v3", "AGPL-3.0"), ("The code is available under the ISC license", "ISC"),
        ("Published under the Eclipse Public License", "EPL-2.0"), ("All data here is released under CC0", "CC0-1.0"), ("License: GPLv2", "GPL-2.0"),
        ("The package is licensed under the terms of the Apache License 2.0", "Apache-2.0"), ("This is free and unencumbered software released into the public domain", "Unlicense"),
        ("Our library may be used in accordance with the GNU Lesser General Public License", "LGPL"), ("Text licensed under CC BY-SA 3.0", "CC-BY-SA"),
        ('The software is provided "as is", without warranty of any kind, express or implied', "MIT"),
        ("In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary damages", "BSD"),
    ]
    others = ["They studied at MIT and moved to Boston.", "A licence to fish is sold in the shop under the bridge.", "Apache helicopters were released in the film.", "The book was published by the museum."]
    texts = list(enumerate([t for t, _ in wanted] + others))
    model = licences.fit_licences(spark.read.parquet(f"{fixtures.SMALL}/documents.parquet"))
    out = licences.find_licences(table(spark, texts), model)
    assert {r["doc_id"]: r["family"] for r in out.collect()} == {i: f for i, (_, f) in enumerate(wanted)}


def test_licence_lines_of_the_test_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    expected = lines.where("line rlike '(?i)licen[sc]e'").count()
    found = licences.find_licences(docs)
    assert found.count() == expected == 39


EMPTY = "doc_id long, text string"


def test_empty_tables_give_empty_results(spark):
    docs = spark.createDataFrame([], EMPTY)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "some item that is long enough to be searched for in texts")], "item_id long, text string")
    for out in (
        quality.quality_scores(docs, labels),
        quality.keep_quality(docs, labels),
        token_counts.token_counts(docs, vocabulary(PIECES)),
        token_files.token_files(docs, vocabulary(WORDS)),
        packing.pack_documents(docs, vocabulary(WORDS)),
        substring.remove_repeated_words(docs),
        licences.find_licences(docs),
        jaccard.jaccard_components(docs),
        exact.exact_duplicates(docs),
        exact.drop_exact_duplicates(docs),
        suffixes.remove_repeated_bytes(docs),
        leaks.find_leaks(docs, items),
    ):
        assert out.columns and out.collect() == []
    assert leaks.find_leaks(spark.createDataFrame([(1, "a")], EMPTY), items.limit(0)).collect() == []


def test_all_texts_null(spark):
    docs = spark.createDataFrame([(1, None), (2, None), (None, None)], EMPTY)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.quality_scores(docs, labels).count() == 3
    assert [r["n_tokens"] for r in token_files.token_files(docs, vocabulary(WORDS)).collect()] == [1, 1, 1]
    assert packing.pack_documents(docs, vocabulary(WORDS)).count() == 3
    assert substring.remove_repeated_words(docs).count() == suffixes.remove_repeated_bytes(docs).count() == 3
    assert jaccard.jaccard_components(docs).count() == exact.exact_duplicates(docs).count() == 3
    assert licences.find_licences(docs).count() == 0
