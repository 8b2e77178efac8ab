"""The pipeline against plain versions of its stages, each applied to what the stage before kept."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import leaks, quality
from millrace.llm.queries import ORACLES, QUERIES, vocabulary
from tests.llm import fixtures
from tools.compare import compare, connect


@pytest.fixture(scope="module")
def stages(spark):
    """doc_id -> text before the first stage and after every filtering stage, and the last stage's rows."""
    docs = spark.read.parquet(f"{fixtures.SMALL}/documents.parquet")
    columns, kept = docs.columns, [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, fixtures.SMALL)
        assert docs.columns == columns, name
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    return kept, corpus_pipeline.STAGES[-1][1](spark, docs, fixtures.SMALL).collect()


def test_quality_rejects_what_the_operator_predicts(spark, stages):
    kept, _ = stages
    docs, labels = (spark.read.parquet(f"{fixtures.SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rejected = {r["doc_id"] for r in quality.quality_scores(docs, labels).where("predicted = 0").collect()}
    assert kept[1] == {i: t for i, t in kept[0].items() if i not in rejected}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good & rejected) <= 0.02 * len(good)


def test_exact_near_and_leak_stages(spark, stages):
    kept, _ = stages
    groups = fixtures.exact_groups(list(kept[1].items()))
    assert kept[2].keys() == {i for i, g in groups.items() if g[2]}
    near = fixtures.near_components(list(kept[2].items()), 80, 5)
    assert kept[3].keys() == {i for i, (_, smallest) in near.items() if i == smallest}
    items = [r["text"] for r in spark.read.parquet(f"{fixtures.SMALL}/benchmark.parquet").collect()]
    index = leaks.ProbeIndex.build(items)

    def leaked(text):
        plain = " ".join(fixtures.words_of(text)).translate({c: c + 32 for c in range(65, 91)}).encode()
        grams = {plain[k : k + leaks.Q] for k in range(len(plain))}
        for probe, edits in zip(index.texts, index.budgets, strict=True):
            shared = sum(probe[k : k + leaks.Q] in grams for k in range(len(probe) - leaks.Q + 1))
            if shared >= 5 and fixtures.edit_distance_within(probe, plain) <= edits:
                return True
        return False

    assert kept[4].keys() == {i for i, t in kept[3].items() if not leaked(t)}


def test_packing_covers_what_is_left(stages):
    from tokenizers import Tokenizer

    kept, pieces = stages
    own = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert {p["doc_id"] for p in pieces} == kept[4].keys()
    for p in pieces:
        ids = [*own.encode(kept[4][p["doc_id"]] or "", add_special_tokens=False).ids, 2]
        part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
        assert (zlib.crc32(part.tobytes()), len(ids)) == (p["ids_crc32"], p["doc_tokens"])
    assert sum(p["length"] for p in pieces) == sum(d for d in {p["doc_id"]: p["doc_tokens"] for p in pieces}.values())


def test_run_gives_the_rows_of_its_stages(spark, stages):
    _, pieces = stages
    out = corpus_pipeline.run(spark, fixtures.SMALL)
    assert {tuple(r)[:5] for r in out.collect()} == {tuple(r)[:5] for r in pieces}


def test_stages_take_empty_and_odd_tables(spark):
    odd = [(1, None), (None, None), (2, ""), (2, ""), (3, "a b c"), (None, "a b c")]
    for rows in ([], odd):
        docs = spark.createDataFrame(fixtures.rows(rows), fixtures.SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, fixtures.SMALL)
            assert out.count() <= max(len(rows), 0), name
            if name != "packing":
                assert out.columns == docs.columns


def test_every_query_returns_its_contract(spark):
    wanted = {
        "op1_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op2_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
        "op3_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
        "op4_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op5_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
        "op7_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op8_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
        "op9_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    }
    assert sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0])) == sorted([*wanted, "op6_licences", "op10_leaks"], key=lambda q: int(q[2:].split("_")[0]))
    rows = spark.read.parquet(f"{fixtures.SMALL}/documents.parquet").agg(F.count("*")).first()[0]
    for name, columns in wanted.items():
        out = QUERIES[name](spark, fixtures.SMALL)
        assert dict(out.dtypes) == columns, name
        assert (out.count() == rows) or name == "op4_packing"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    assert compare(spark, connect(fixtures.SMALL), fixtures.SMALL, name) == []
