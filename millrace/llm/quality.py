"""A quality classifier on document statistics: random Fourier features, ridge scores, isotonic calibration.

Each text becomes a short vector of statistics (lengths, shares of character classes, repeated words and
lines). After standardising, cosines of random projections approximate a Gaussian kernel on them. The
normal equations of ridge regression are sums over documents: each partition sums its part, the
parts are added row by row in a shuffle, and the driver solves systems of the features' size. The sums are
kept by fold: each fold's documents are scored by the fit to the other folds, and those scores calibrated
by isotonic regression over score bins. The final weights are fitted on all folds.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import blocks
from millrace.llm.rows import drop_rows
from millrace.sinks.scratch import scratch_path

STATISTICS = (
    "bytes", "words", "mean_word", "spread_word", "upper", "digit", "stop", "shout", "bar", "symbol",
    "high", "line", "distinct_words", "top_word", "marked_words", "repeated_lines", "upper_words", "short_words",
)
BINS = 4096
#: Remainders of crc32(doc_id) modulo 4 that labels are learned from; 2 is held out.
FOLDS = (0, 1, 3)


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.int64)  # 0: other
    kind[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
    kind[[ord(c) for c in "0123456789"]] = 2
    kind[[ord(c) for c in ".,;:'\"()-"]] = 3
    kind[[ord(c) for c in "!?"]] = 4
    kind[ord("|")] = 5
    kind[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 6
    kind[128:] = 7
    kind[[0x0A, 0x0D]] = 8
    return kind


_KIND = _classes()


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _per_text(values: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=texts)


def _repeats(keys: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct keys, and the count of its most frequent key."""
    if not len(keys):
        return np.zeros(texts), np.zeros(texts)
    own = blocks.mix(keys + blocks.mix(owner.astype(np.uint64)))
    _, at, count = np.unique(own, return_index=True, return_counts=True)
    distinct = np.bincount(owner[at], minlength=texts).astype(float)
    top = np.zeros(texts)
    np.maximum.at(top, owner[at], count)
    return distinct, top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of `STATISTICS` per text of a block."""
    texts = len(offsets) - 1
    sizes = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    kinds = _KIND[data]
    table = np.bincount(owner * 9 + kinds, minlength=texts * 9).reshape(texts, 9).astype(float)
    starts, ends, before = blocks.word_bounds(data, offsets)
    words = np.diff(before).astype(float)
    word_of = np.repeat(np.arange(texts), np.diff(before))
    length = (ends - starts).astype(float)
    mean = _share(_per_text(length, word_of, texts), words)
    spread = np.sqrt(np.maximum(_share(_per_text(length**2, word_of, texts), words) - mean**2, 0))
    sums = blocks.prefix_hash(data)
    distinct, top = _repeats(blocks.span_hash(sums, starts, ends), word_of, texts)
    noisy = np.isin(kinds[ends - 1], (4, 5, 6)) if len(ends) else np.zeros(0, bool)
    capital = np.concatenate([[0], np.cumsum(kinds == 1)])
    upper = (capital[ends] - capital[starts] >= np.maximum(2, 0.6 * length)) if len(ends) else np.zeros(0, bool)

    cuts = np.zeros(len(data) + 1, bool)
    cuts[offsets] = True
    cuts[np.flatnonzero(data == 0x0A) + 1] = True
    edges = np.flatnonzero(cuts)
    line_of = np.searchsorted(offsets, edges[:-1], side="right") - 1
    lines = np.bincount(line_of, minlength=texts).astype(float) if len(line_of) else np.zeros(texts)
    kinds_of_line, _ = _repeats(blocks.span_hash(sums, edges[:-1], edges[1:]), line_of, texts)
    return np.column_stack(
        [
            np.log1p(sizes), np.log1p(words), mean, np.log1p(spread),
            *(_share(table[:, k], sizes) for k in range(1, 9)),
            _share(distinct, words), _share(top, words), _share(_per_text(noisy, word_of, texts), words),
            _share(lines - kinds_of_line, lines), _share(_per_text(upper, word_of, texts), words),
            _share(_per_text(length <= 3, word_of, texts), words),
        ]
    )


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in blocks.blocks(batch.column(1)):
            values = statistics(data, offsets)
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), values.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), vectors.cast(pa.list_(pa.float64()))], ["doc_id", "stats"]
            )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text; a null text counts as empty. No shuffle."""
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return wanted.mapInArrow(_measure, "doc_id long, stats array<double>")


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from: crc32 of the doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclasses.dataclass(frozen=True)
class Model:
    """Everything a task needs to score; its size depends on the number of features only."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features of the standardised statistics, and a constant."""
        standard = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.cos(standard @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([waves, np.ones(len(stats))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        # A thousandth of the raw order is kept, so that equal calibrated values still rank.
        return np.clip(0.999 * np.interp(raw, self.knots, self.levels) + 0.001 * np.clip((raw + 1) / 3, 0, 1), 0, 1)


def _matrix(batch: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sum_equations(model: Model):
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.phases) + 1
        total = np.zeros((len(FOLDS), size, size + 1))
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.slice(lo, 4096)
                fold = part.column("fold").to_numpy(zero_copy_only=False)
                features, label = model.features(_matrix(part)), part.column("label").to_numpy(zero_copy_only=False)
                for k, own in enumerate(FOLDS):
                    x, y = features[fold == own], label[fold == own]
                    total[k, :, :size] += x.T @ x
                    total[k, :, size] += x.T @ y
        rows = pa.FixedSizeListArray.from_arrays(pa.array(total.reshape(-1)), size + 1).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(FOLDS) * size), pa.int32()), rows], ["i", "sums"])

    return add


def _solve(system: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights from summed equations; the last feature is the constant, whose sum counts the rows."""
    size = len(system)
    penalty = (0.1 + ridge * system[-1, size - 1] / size) * np.eye(size)
    penalty[-1, -1] = 1e-9
    return np.linalg.lstsq(system[:, :size] + penalty, system[:, size], rcond=None)[0]


def _add_rows(table: pa.Table) -> pa.Table:
    """Sum of the partitions' versions of one row of the equations."""
    vectors = np.stack([np.asarray(v) for v in table.column("sums").to_pylist()])
    return pa.table({"i": pa.array([table.column("i")[0].as_py()], pa.int32()), "sums": pa.array([vectors.sum(axis=0).tolist()], pa.list_(pa.float64()))})


def _scores(model: Model, score: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.score(_matrix(batch)) if score else model.raw(_matrix(batch))
            names = [n for n in batch.schema.names if n != "stats"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(values)], [*names, "value"])

    return run


def isotonic(values: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators on points ascending in `values`: knots and non-decreasing levels."""
    pools: list[list[float]] = []  # weighted value, weighted label, weight
    for v, y, w in zip(values.tolist(), labels.tolist(), weights.tolist(), strict=True):
        pools.append([v * w, y * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    table = np.array(pools)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def labelled_rows(stats: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Statistics and label (0 or 1) of the documents labels may be learned from, and their fold.

    Null labels are left out; of several labels of a document their mean counts.
    """
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("label"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return stats.join(one.where(~held_out(F.col("doc_id"))), "doc_id").withColumn("fold", fold)


def fit(
    stats: DataFrame, labels: DataFrame, features: int = 256, ridge: float = 1e-3, max_rows: int = 400_000, seed: int = 7
) -> Model | None:
    """Fit on at most about `max_rows` labelled documents, chosen by a hash of the doc_id; None without labels."""
    rows = labelled_rows(stats, labels)
    found = rows.agg(F.count("*").alias("n")).first()["n"]
    if not found:
        return None
    share = int(1e6 * min(1.0, max_rows / found))
    place = scratch_path(stats.sparkSession, "quality_rows")
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    chosen.select("doc_id", "stats", "label", "fold").repartition(32, "doc_id").write.parquet(place)
    rows = stats.sparkSession.read.parquet(place)
    size = len(STATISTICS)
    moments = rows.agg(
        *[F.avg(F.col("stats")[k]).alias(f"m{k}") for k in range(size)],
        *[F.stddev_pop(F.col("stats")[k]).alias(f"s{k}") for k in range(size)],
    ).first()
    mean = np.array([moments[f"m{k}"] for k in range(size)])
    scale = np.array([moments[f"s{k}"] for k in range(size)])
    scale[~(scale > 1e-9)] = 1.0
    random = np.random.default_rng(seed)
    # Kernel width: two typical standardised vectors differ by the root of twice their size.
    directions = random.normal(size=(size, features)) / np.sqrt(2 * size) * 1.5
    phases = random.uniform(0, 2 * np.pi, features)
    model = Model(mean, scale, directions, phases, np.zeros(features + 1), np.zeros(1), np.ones(1))

    parts = rows.select("stats", "label", "fold").mapInArrow(_sum_equations(model), "i int, sums array<double>")
    systems = np.zeros((len(FOLDS) * (features + 1), features + 2))
    for row in parts.groupBy("i").applyInArrow(_add_rows, "i int, sums array<double>").collect():
        systems[row["i"]] = row["sums"]
    systems = systems.reshape(len(FOLDS), features + 1, features + 2)
    every = systems.sum(axis=0)
    model = dataclasses.replace(model, weights=_solve(every, ridge))

    scored = None
    for k, fold in enumerate(FOLDS):
        others = every - systems[k]
        apart = model if others[-1, features] < 1 else dataclasses.replace(model, weights=_solve(others, ridge))
        part = rows.where(F.col("fold") == fold).select("label", "stats")
        part = part.mapInArrow(_scores(apart, score=False), "label double, value double")
        scored = part if scored is None else scored.union(part)
    slot = F.floor((F.greatest(F.least("value", F.lit(2.0)), F.lit(-1.0)) + 1) / 3 * (BINS - 1)).alias("slot")
    sums = scored.groupBy(slot).agg(F.avg("value").alias("v"), F.avg("label").alias("y"), F.count("*").alias("w"))
    bins = sorted((r["v"], r["y"], r["w"]) for r in sums.collect())
    knots, levels = isotonic(*(np.array(x, float) for x in zip(*bins, strict=True)))
    return dataclasses.replace(model, knots=knots, levels=levels)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 400_000) -> DataFrame:
    """doc_id, held_out, score (0 to 1; higher: label 1 likelier) and predicted (1 from `threshold` up).

    `docs` has `doc_id` and `text`, `labels` has `doc_id` and `quality`; other columns are ignored, and only
    the text enters a score. A null text counts as empty and is scored too; a null doc_id stays
    null and is never learned from; repeated rows get equal scores. Without any label to learn from every
    score is 1: nothing speaks against a document. An empty table gives no rows.

    The statistics are saved in the shared folder (some 100 bytes a document), as fitting and scoring both
    read them. Fitting takes about `max_rows` labelled rows at most.
    """
    spark = docs.sparkSession
    place = scratch_path(spark, "quality_statistics")
    document_statistics(docs).write.parquet(place)
    stats = spark.read.parquet(place)
    model = fit(stats, labels, max_rows=max_rows)
    if model is None:
        scored = stats.select("doc_id", F.lit(1.0).alias("score"))
    else:
        scored = stats.mapInArrow(_scores(model, score=True), "doc_id long, value double").withColumnRenamed("value", "score")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` that the classifier does not reject; rows without doc_id stay."""
    return drop_rows(docs, quality_scores(docs, labels, threshold).where("predicted = 0"))
