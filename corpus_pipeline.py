"""A corpus pipeline: reject low quality, drop exact and near duplicates, remove benchmark leaks, pack."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from millrace.llm import exact, jaccard, leaks, packing, quality, workers  # noqa: E402
from millrace.llm.queries import vocabulary  # noqa: E402
from millrace.sinks.scratch import scratch_path  # noqa: E402


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, does not reject."""
    workers.reach(spark)
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest doc_id."""
    workers.reach(spark)
    return exact.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 of their five-word shingles, the smallest doc_id."""
    workers.reach(spark)
    return jaccard.keep_one_per_component(docs, percent=80, words=5)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    workers.reach(spark)
    return leaks.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into windows of 4096 tokens."""
    workers.reach(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=2, window=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", near_stage),
    ("decontamination", leak_stage),
    ("packing", packing_stage),
]

#: Training, tokenising and alignment are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; each stage's rows are saved in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        place = scratch_path(spark, f"pipeline_{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
