"""Language identification, ranked search and collocations against plain versions."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from millrace.llm import collocations, languages, queries, ranked
from tests.llm import fixtures

LOWER = {c: c + 0x20 for c in range(0x41, 0x5B)}
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string, score double, rank string"


# Languages


def lang_table(spark, rows):
    """doc_id, text, lang, and columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", 0.5, 1) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double, size int").repartition(3)


def test_sizes_are_those_of_each_piece_with_each_dictionary():
    texts = {"a": b"the cat sat on the mat and the dog " * 9, "b": b"der hund und die katze sitzen " * 9}
    own = languages.Compressors(texts)
    text = ("The CAT 77 sat, on the dog!\n" * 400).encode()
    for k, lang in enumerate(("a", "b")):
        dictionary = zstandard.ZstdCompressionDict(texts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        plain = zstandard.ZstdCompressor(level=6, dict_data=dictionary, write_content_size=False, write_dict_id=False)
        total = 0
        for at in range(0, len(text), 4096):
            words = re.findall("[a-z]+", text[at : at + 4096].decode().lower())
            total += len(plain.compress(" ".join(words).encode()))
        assert own.sizes(text)[k] == total
    assert own.sizes(text)[0] < own.sizes(text)[1]


def test_the_smallest_size_wins_and_narrow_margins_are_told():
    assert languages.judge([50, 40, 80])[0] == 1
    assert languages.judge([40, 40])[0] == 0  # the first by name
    assert languages.judge([40, 40])[1:] == (0.5, 0.0)
    assert languages.judge([30]) == (0, 1.0, 1.0)
    best, score, margin = languages.judge([100, 90])
    assert (best, margin) == (1, pytest.approx(0.1)) and 0.99 < score < 1


def test_texts_without_letters_are_undetermined(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 — 34 !? 😀", "en"), (None, "the story of the end of the story of the end", "en"), (5, "日本", "en"), (5, "der " * 100_000, None)]
    out = languages.identify_languages(lang_table(spark, rows), {"de": b"der die das und " * 20, "en": b"the end of the story " * 20})
    got = sorted(((r.doc_id, r.lang_pred, r.rejected) for r in out.collect()), key=repr)
    und = [(1, "und", True), (2, "und", True), (3, "und", True)]
    assert [g for g in got if g[0] in (1, 2, 3)] == und
    assert (None, "en", False) in got and (5, "de", False) in got
    assert len(got) == len(rows) and out.columns[:3] == ["doc_id", "lang_pred", "score"]
    assert all(0 <= r.score <= 1 for r in out.collect())


def test_without_labelled_texts_nothing_is_determined(spark):
    rows = lang_table(spark, [(1, "the end", None), (2, None, "en"), (3, "", "en")])
    assert languages.fit_dictionaries(rows) == {}
    assert {r.lang_pred for r in languages.identify_languages(rows, {}).collect()} == {"und"}
    assert languages.identify_languages(rows.limit(0), {"en": b"the end of it"}).count() == 0


def test_dictionaries_hold_different_texts_whatever_their_copies_and_order(spark):
    rows = [(i, f"text number {chr(97 + i % 20)} of the language", "en") for i in range(400)]
    rows += [(1000 + i, "the very same copy", "en") for i in range(800)] + [(1, "eins zwei", "de")]
    first = languages.fit_dictionaries(lang_table(spark, rows), texts=50)
    random.Random(3).shuffle(rows)
    assert languages.fit_dictionaries(lang_table(spark, rows).repartition(7), texts=50) == first
    lines = first["en"].split(b"\n")
    assert len(lines) == len(set(lines)) <= 50 and first["de"].split() == [b"eins", b"zwei"]


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet(f"{fixtures.SMALL}/documents.parquet")
    out = queries.op11_languages(spark, fixtures.SMALL)
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    sure = [r.lang == r.lang_pred for r in rows if r.held_out and not r.rejected]
    assert sum(held) / len(held) >= 0.95 and sum(sure) / len(sure) >= 0.97


# Ranked search


def plain_search(docs, items, k):
    """item -> [(rank, doc_id, score)], by scoring every document."""
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    total, words = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item].update(TERM.findall((text or "").translate(LOWER)))
    out = {}
    for item, own in wanted.items():
        scored = []
        for doc, t in terms:
            tf, score = Counter(t), 0
            for w in own & tf.keys():
                m = 10 + (90 * len(t) * total) // words
                score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort()
        out[item] = [(n + 1, doc, -s) for n, (s, _, _, doc) in enumerate(scored[:k])]
    return {i: rows for i, rows in out.items() if rows}


def found(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.item_id].append((r["rank"], r.doc_id, r.score))
    return {i: sorted(rows) for i, rows in out.items()}


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_ranked_search_equals_scoring_every_document(spark, block_bytes):
    docs = fixtures.corpus(21, 120)
    docs += [(None, docs[0][1]), (None, None), (docs[1][0], docs[1][1]), (docs[1][0], "Åb ÅB a1 A1"), (7_000_001, "ab" * 50), (7_000_002, "ab" * 50)]
    rng = random.Random(5)
    items = [(n, " ".join((rng.choice(docs)[1] or "").split()[:12])) for n in range(12) if n != 4]
    items += [(3, "more of THREE åb a1"), (50, None), (51, ""), (52, "..."), (None, "Åb a1"), (53, "ab" * 50), (54, "neverseenanywhere")]
    out = ranked.ranked_search(
        spark.createDataFrame(fixtures.rows(docs), fixtures.SCHEMA).repartition(3),
        spark.createDataFrame([(i, t, 1.0, "x") for i, t in items], ITEMS), 10, block_bytes,
    )
    assert found(out) == plain_search(docs, items, 10)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame(fixtures.rows([(1, "one two")]), fixtures.SCHEMA)
    items = spark.createDataFrame([(1, "two", 1.0, "x")], ITEMS)
    assert found(ranked.ranked_search(docs, items)) == plain_search([(1, "one two")], [(1, "two")], 10)
    assert ranked.ranked_search(docs.limit(0), items).count() == 0
    assert ranked.ranked_search(docs, items.limit(0)).count() == 0


def test_intervals_end_with_exact_scores_and_all_ties():
    rng = np.random.default_rng(8)
    for size, terms, values in ((3000, 6, 5), (5000, 3, 1000), (40, 8, 2), (2000, 1, 1)):
        ids = rng.permutation(size).astype(np.int64)
        owners, words = np.nonzero(rng.random((size, terms)) < 0.4)
        gains = rng.integers(0, values, len(owners)) * 1000
        lists = ranked.Lists(ids, owners.astype(np.int32), words.astype(np.int32), gains, terms)
        total = np.bincount(owners, weights=gains, minlength=size).astype(np.int64)
        order = np.lexsort((ids, -total))
        order = order[total[order] > 0][:10]
        at, scores = lists.best(np.arange(terms), 10)
        assert at[scores > 0].tolist() == order.tolist() and scores[scores > 0].tolist() == total[order].tolist()


def test_long_texts_are_cut_between_terms_only():
    rng = random.Random(2)
    text = "".join(rng.choice(["ab ", "é", "ccc. ", "d" * 70_000 + " "]) for _ in range(400))
    keys = np.sort(ranked.term_keys(["ab", "ccc", "é"]))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["ab", text, None])], ["doc_id", "text"])
    assert len(list(ranked.pieces(batch.column(1)))) > 3
    shards = list(ranked._index(keys)(iter([batch])))
    assert len(shards) == 1
    row = shards[0].to_pylist()[0]
    every = TERM.findall(text)
    assert (row["docs"], row["terms"]) == (2, 1 + len(every))
    got = ranked._unpacked(row["counts"], np.int32).tolist()
    words = ranked._unpacked(row["words"], np.int32).tolist()
    count = Counter(every)
    expected = Counter({int(np.flatnonzero(keys == ranked.term_keys([w])[0])[0]): count[w] for w in ("ab", "ccc", "é") if count[w]})
    expected[int(np.flatnonzero(keys == ranked.term_keys(["ab"])[0])[0])] += 1
    sums = Counter()
    for w, c in zip(words, got, strict=True):
        sums[w] += c
    assert sums == expected


# Collocations


def plain_collocations(docs, longest, least, percent, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(
                len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items()
            ):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, l, r, score))
        for rank, (_, _, phrase, a, l, r, score) in enumerate(sorted(kept)[:top]):
            out.append((lang, rank + 1, phrase.decode(), a, l, r, n[lang], score))
    return sorted(out)


def phrases(seed, count=150):
    rng = random.Random(seed)
    words = ["Aa", "b", "é", "dd", "x1", "\x01", "b\x01", "the", "Of"]
    out = []
    for _ in range(count):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! "]) for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return [*out, ("en", None), (None, None), ("fr", ""), ("de", "..."), *[("en", "same passage of many copies")] * 40]


@pytest.mark.parametrize(("longest", "least", "top"), [(3, 10, 2000), (2, 3, 7), (4, 4, 25)])
def test_collocations_equal_plain_counting(spark, longest, least, top):
    docs = phrases(longest)
    table = spark.createDataFrame([(i, t, g, 1, "x", 9) for i, (g, t) in enumerate(docs)], "doc_id long, text string, lang string, a int, ids string, chunk int")
    out = collocations.collocations(table.repartition(3), longest, least, 50, top)
    assert sorted(tuple(r) for r in out.collect()) == plain_collocations(docs, longest, least, 50, top)


def test_collocations_of_an_empty_table(spark):
    table = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(table).count() == 0
    rare = spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")
    assert collocations.collocations(rare).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    grams = spark.createDataFrame([("en", [1], 3 * 10**9 + 1), ("en", [2], 3 * 10**9 + 7), ("en", [1, 2], 3 * 10**9)], "lang string, ids array<long>, a long")
    row = collocations.cut_scores(grams).collect()[0]
    assert row.score == 10**6 * (3 * 10**9) ** 2 // ((3 * 10**9 + 1) * (3 * 10**9 + 7))


def test_long_texts_and_small_chunks_lose_no_phrase(monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice(["a ", "b ", "c", ". ", "\t", "d" * 90_000 + " "]) for _ in range(600))
    texts = ["a b a b.", long, "b a", None, "a a a", long[:100]]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    assert len(list(collocations._stretches(batch.column(1)))) > 3
    expected = Counter()
    for text in texts:
        for piece in re.split("[.,;:!?\n-\r]", text or ""):
            words = re.findall("[^ \t]+", piece)
            expected.update(tuple(words[i : i + s]) for s in (2, 3) for i in range(len(words) - s + 1))
    for chunk_words in (10**9, 50):
        monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk_words)
        got, chunks = Counter(), list(collocations._encode(iter([batch])))
        for chunk in chunks:
            row = chunk.to_pylist()[0]
            codes = collocations._unpacked(row["codes"], np.int32)
            marks = zstandard.ZstdDecompressor().decompress(row["begins"])
            begins = np.unpackbits(np.frombuffer(marks, np.uint8), count=len(codes)).astype(bool)
            for _, columns, counts in collocations.phrase_counts(codes, begins, np.arange(len(row["words"])), 3):
                for ids, count in zip(columns.T.tolist(), counts.tolist(), strict=True):
                    got[tuple(row["words"][i] for i in ids)] += count
        assert got == expected and (len(chunks) > 1) == (chunk_words == 50)


def test_queries_equal_their_sql(spark):
    from tools.compare import compare, connect

    for name in ("op12_ranked", "op13_collocations"):
        assert compare(spark, connect(fixtures.SMALL), fixtures.SMALL, name) == []


def test_held_out_rows_without_id(spark):
    assert spark.range(1).select((F.crc32(F.lit("").cast("binary")) % 3 == 1).alias("x")).first().x is False


# Leaks in texts that repeat themselves


def test_a_text_of_one_repeated_character_is_searched_in_bounded_memory():
    import tracemalloc

    from millrace.llm import leaks

    index = leaks.ProbeIndex.build(["_" * 300, "abc def " * 20, None])
    assert index.items[0] == {0: 7}  # one probe, however often it stands in its item
    texts = ["_" * 60_000, "abc def " * 30, "_" * 70]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    tracemalloc.start()
    text, probe, distance, place = leaks.find_regions(index, data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    own = (text == 0) & (probe == 0)
    assert (distance[own].min(), place[own & (distance == 0)].min()) == (0, 80)
    assert set(text[distance == 0].tolist()) == {0, 1} and not (text == 2).any()


def test_probes_of_an_item_are_counted_with_their_repeats(spark):
    from millrace.llm import leaks

    docs = spark.createDataFrame(fixtures.rows([(1, "x " + "_" * 500), (2, "nothing"), (3, None)]), fixtures.SCHEMA)
    items = spark.createDataFrame([(8, "_" * 300, 1.0, "x"), (9, "_" * 300, 1.0, "x"), (10, "", 1.0, "x")], ITEMS)
    out = sorted(tuple(r)[:4] for r in leaks.find_leaks(docs, items).collect())
    assert out == [(1, 8, 7, 0), (1, 9, 7, 0)]
