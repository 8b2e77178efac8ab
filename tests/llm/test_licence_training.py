"""The licence classifier is trained and calibrated on every paragraph."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import licences
from tests.llm import fixtures


def test_every_paragraph_trains_or_calibrates(spark, monkeypatch):
    seen = {}

    class Recorded(licences.LogisticRegression):
        def fit(self, dataset):
            seen["fit"] = dataset.where("label = 0").agg(F.sum("weight")).first()[0]
            return super().fit(dataset)

    threshold = licences._threshold

    def recorded(counts, rate):
        seen["calibrate"] = sum(counts.values())
        return threshold(counts, rate)

    monkeypatch.setattr(licences, "LogisticRegression", Recorded)
    monkeypatch.setattr(licences, "_threshold", recorded)
    line = F.concat(F.lit("thing x"), F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(" of the house")).otherwise(F.lit("")))
    lines = spark.range(60_000).select("id", line.alias("line"), (F.pmod(F.xxhash64(licences.words_of(line), F.lit(1)), F.lit(2)) == 0).alias("fit"))
    docs = lines.groupBy((F.col("id") % 50).alias("doc_id")).agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
    licences.fit_licences(docs)
    assert seen["fit"] == lines.where("fit").count()
    assert seen["fit"] + seen["calibrate"] == 60_000


def test_threshold_lets_the_given_share_pass():
    counts = {1: 900.0, 5_001: 50.0, 6_000: 40.0, 9_950: 10.0}
    assert licences._threshold(counts, 0.005) == 0.99
    assert licences._threshold(counts, 0.02) == 0.6
    assert licences._threshold(counts, 0.06) == 0.5001
    assert licences._threshold(counts, 0.2) == licences._threshold({}, 0.2) == 0.5


def test_a_notice_of_everyday_words_is_looked_at(spark):
    docs = spark.createDataFrame([(1, "Prose.\nyou may not use this file"), (2, "you may sit down")], "doc_id long, text string")
    model = licences.fit_licences(spark.read.parquet(f"{fixtures.SMALL}/documents.parquet"))
    assert [(r["doc_id"], r["paragraph"], r["family"]) for r in licences.find_licences(docs, model).collect()] == [(1, 1, "Apache-2.0")]
