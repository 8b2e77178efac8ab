"""Documents linked by the Jaccard similarity of their word shingles, exactly, as connected components.

1. Texts with equal shingle sets are one class, whose smallest doc_id stands for it.
2. Every shingle's documents are counted, over all texts. A text's shingles are put in order of that count,
   rarest first. Linked texts share one of the first few: more are missing than a link allows otherwise.
   Texts that share one of those join one cluster; passages that many documents share come last in the
   order and do not join them.
3. T-occurrence search within each cluster: inverted lists over the members' whole sets. A query's short
   lists are merged; its longest ones are set aside and probed by binary search (DivideSkip). Members
   reaching the required overlap are linked. A cluster of more members than a task should hold
   is searched in cells, each a pair of member lots, so no link is lost.
4. Components of the links give each document its component.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import blocks
from millrace.llm.components import connected_components
from millrace.llm.repeats import dealt, grouped, keyed
from millrace.llm.rows import drop_rows
from millrace.sinks.scratch import scratch_path

#: Members of a cluster that one task takes as one lot.
LOT = 1_000
#: Shingles gathered in a task before they are dealt out.
FLUSH = 2_000_000
#: Entries of short lists up to which they are merged by a heap; longer ones are counted in one pass.
HEAP_ENTRIES = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a block, ascending, end to end; and where each begins.

    A text of fewer words has its whole word sequence as its one shingle, a text without words none.
    """
    starts, ends, before = blocks.word_bounds(data, offsets)
    hashes = blocks.span_hash(blocks.prefix_hash(_LOWER[data]), starts, ends)
    counts, texts = np.diff(before), len(offsets) - 1
    grams = blocks.gram_hash(hashes, words)
    owner = np.repeat(np.arange(texts), counts)[: len(grams)]
    # A shingle must end in its own text.
    grams, owner = (x[np.arange(len(grams)) + words <= before[owner + 1]] for x in (grams, owner))
    for n in range(1, words):
        short = np.flatnonzero(counts == n)
        whole = np.zeros(len(short), np.uint64)
        for k in range(n):
            whole = blocks.mix(whole + hashes[before[short] + k] + np.uint64(n))
        grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(texts + 1))


def _describe(words: int):
    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks.blocks(batch.column(1)):
                grams, bounds = shingle_sets(data, offsets, words)
                sums = np.zeros((2, hi - lo), np.uint64)
                owner = np.repeat(np.arange(hi - lo), np.diff(bounds))
                for row, seed in zip(sums, (1, 2), strict=True):
                    np.add.at(row, owner, blocks.mix(grams * np.uint64(2) + np.uint64(seed)))
                columns = [np.diff(bounds), sums[0].view(np.int64), sums[1].view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *map(pa.array, columns)], ["doc_id", "n_shingles", "set_1", "set_2"]
                )

    return describe


def _send_shingles(words: int, buckets: int):
    """Shingles as bucket and 32 further bits: those that agree count as one, for all documents alike. A few
    look less rare than they are; the order stays one for all, so no link is lost."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            bucket, residual = dealt(np.concatenate(held), buckets)
            part = np.concatenate(parts)
            held.clear(), parts.clear()
            order = np.argsort(bucket * (int(part.max()) + 1) + part, kind="stable")
            bucket, part, residual = bucket[order], part[order], residual[order]
            cut = np.concatenate([[0], np.flatnonzero((part[1:] != part[:-1]) | (bucket[1:] != bucket[:-1])) + 1, [len(part)]])
            spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[cut[:-1]], pa.int32()), pa.array(part[cut[:-1]], pa.int32()), pa.array([residual[x:y].tobytes() for x, y in spans], pa.binary())],
                ["bucket", "part", "shingles"],
            )

        for batch in batches:
            part = batch.column(2).to_numpy()
            for lo, hi, data, offsets in blocks.blocks(batch.column(1)):
                grams, bounds = shingle_sets(data, offsets, words)
                held.append(grams)
                parts.append(np.repeat(part[lo:hi], np.diff(bounds)))
                if sum(map(len, held)) >= FLUSH:
                    yield flush()
        if sum(map(len, held)):
            yield flush()

    return send


def _count_shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: to each part, its shingles that more than one text has, with the logarithm of how many."""
    for rows in grouped(batches, "bucket"):
        lists = [np.frombuffer(r["shingles"], np.uint32) for r in rows]
        every = np.concatenate(lists)
        owner = np.repeat([r["part"] for r in rows], [len(x) for x in lists])
        values, which, counts = np.unique(every, return_inverse=True, return_counts=True)
        rank = np.ceil(np.log2(counts)).astype(np.uint8)
        shared = np.flatnonzero(counts[which] > 1)
        key = np.unique(owner[shared] * (1 << 32) + every[shared].astype(np.int64))
        value = (key & 0xFFFFFFFF).astype(np.uint32)
        parts, begin = np.unique(key >> 32, return_index=True)
        ranks = rank[np.searchsorted(values, value)]
        spans = list(zip(begin.tolist(), [*begin[1:].tolist(), len(key)], strict=False))[: len(parts)]
        if len(parts):
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), pa.array([rows[0]["bucket"]] * len(parts), pa.int32()),
                 *(pa.array([v[x:y].tobytes() for x, y in spans], pa.binary()) for v in (value, ranks))],
                ["part", "bucket", "shingles", "ranks"],
            )


def _deal_rarest(words: int, percent: int, buckets: int):
    """Of each text the rarest shingles that suffice, but those it alone has: (bucket, shingles, documents)."""

    def deal(texts: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int32()), ("marks", pa.binary()), ("docs", pa.binary())])
        known, ranks = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for row in answers.to_pylist():
            known.append(keyed(row["bucket"], np.frombuffer(row["shingles"], np.uint32)))
            ranks.append(np.frombuffer(row["ranks"], np.uint8))
        known, ranks = np.concatenate(known), np.concatenate(ranks)
        order = np.argsort(known)
        known, ranks = known[order], ranks[order]
        if not len(known) or not texts.num_rows:
            return schema.empty_table()
        valid = texts.column("doc_id").is_valid().to_numpy()
        ids = texts.column("doc_id").fill_null(0).to_numpy()
        marks, docs = [], []
        for lo, hi, data, offsets in blocks.blocks(texts.column("text")):
            grams, bounds = shingle_sets(data, offsets, words)
            key = keyed(*dealt(grams, buckets))
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            rank = np.where(known[at] == key, ranks[at], 0)
            sizes = np.diff(bounds)
            owner = np.repeat(np.arange(hi - lo), sizes)
            order = np.lexsort((grams, rank, owner))
            first = sizes - -(-percent * sizes // 100) + 1
            place = np.arange(len(grams)) - bounds[owner]
            use = order[(place < first[owner]) & (rank[order] > 0) & valid[lo:hi][owner]]
            marks.append(grams[use])
            docs.append(ids[lo:hi][owner[use]])
        mark, doc = np.concatenate(marks), np.concatenate(docs)
        bucket = (mark % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(b, mark[order[x:y]].tobytes(), doc[order[x:y]].tobytes()) for b, (x, y) in enumerate(zip(cut.tolist(), cut[1:].tolist(), strict=False)) if y > x]
        return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return deal


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: for each shingle, its smallest document with every other one."""

    def edges(marks: list[bytes], docs: list[bytes]) -> pa.RecordBatch:
        mark = np.concatenate([np.frombuffer(m, np.uint64) for m in marks])
        doc = np.concatenate([np.frombuffer(d, np.int64) for d in docs])
        order = np.lexsort((doc, mark))
        mark, doc = mark[order], doc[order]
        first = np.ones(len(mark), bool)
        first[1:] = mark[1:] != mark[:-1]
        centre = doc[np.flatnonzero(first)][np.cumsum(first) - 1]
        pairs = np.unique(np.stack([centre, doc], axis=1)[centre != doc], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    bucket, marks, docs = None, [], []
    for batch in batches:
        for b, m, d in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if b != bucket and marks:
                yield edges(marks, docs)
                marks, docs = [], []
            bucket = b
            marks.append(m)
            docs.append(d)
    if marks:
        yield edges(marks, docs)


def merge_short(lists: list[np.ndarray], need: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries that stand in at least `need` of the ascending lists, and in how many.

    A heap holds the head of each list. If fewer than `need` heads agree, as many heads as could not matter
    are popped, and their lists skip by binary search to the new top.
    """
    if sum(map(len, lists)) > HEAP_ENTRIES:
        entries, counts = np.unique(np.concatenate(lists), return_counts=True)
        return entries[counts >= need], counts[counts >= need]
    plain = [x.tolist() for x in lists if len(x)]
    heap = [(x[0], k, 0) for k, x in enumerate(plain)]
    heapq.heapify(heap)
    found, counts = [], []
    while len(heap) >= need:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            found.append(top)
            counts.append(len(popped))
            skip_to = top + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            skip_to = heap[0][0]
        for _, k, at in popped:
            at = bisect_left(plain[k], skip_to, at)
            if at < len(plain[k]):
                heapq.heappush(heap, (plain[k][at], k, at))
    return np.array(found, np.int64), np.array(counts, np.int64)


def link_members(sets: list[np.ndarray], percent: int, reserve: float = 0.01) -> np.ndarray:
    """For each set the smallest member index of its component, by T-occurrence search over all of them.

    Members already connected are not compared again: only the components are asked for.
    """
    count = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(count), sizes)
    _, token = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    keys = np.sort(token * count + owner)  # all inverted lists, end to end
    entries = keys % count
    first = np.searchsorted(keys // count, np.arange((token.max() if len(token) else -1) + 2))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    label = np.arange(count)
    for i in range(count):
        size = int(sizes[i])
        if not size or (label[i + 1 :] == label[i]).all():
            continue
        smallest = -(-percent * size // 100)
        need = -(-percent * (size + smallest) // (100 + percent))
        mine = token[begin[i] : begin[i + 1]]
        start = np.searchsorted(keys, mine * count + i + 1)  # members after i only
        lengths = first[mine + 1] - start
        order = np.argsort(-lengths, kind="stable")
        aside = min(need - 1, int(need / (reserve * np.log2(max(int(lengths.max()), 2)) + 1)))
        short = order[aside:]
        lists = [entries[start[k] : start[k] + lengths[k]] for k in short.tolist() if lengths[k]]
        if len(lists) < need - aside:
            continue
        found, counts = merge_short(lists, need - aside)
        able = (label[found] != label[i]) & (sizes[found] >= smallest) & (percent * sizes[found] <= 100 * size)
        found, counts = found[able], counts[able]
        if not len(found):
            continue
        probes = (mine[order[:aside]] * count)[:, None] + found
        at = np.minimum(np.searchsorted(keys, probes), len(keys) - 1)
        overlap = counts + (keys[at] == probes).sum(axis=0)
        linked = found[(100 + percent) * overlap >= percent * (size + sizes[found])]
        for old in np.unique(label[linked]).tolist():
            if old != label[i]:
                low, high = sorted((old, int(label[i])))
                label[label == high] = low
    return label


def _search(words: int, percent: int):
    """Rows sorted by cluster and cell: links of each cell's members to the smallest of their component."""

    def links(cluster: int, ids: list[int], texts: list) -> pa.RecordBatch:
        sets: list[np.ndarray] = []
        for _, _, data, offsets in blocks.blocks(pa.array(texts, pa.large_string())):
            grams, bounds = shingle_sets(data, offsets, words)
            sets += [grams[bounds[k] : bounds[k + 1]] for k in range(len(bounds) - 1)]
        label = link_members(sets, percent)
        key = np.array(ids, np.int64)
        apart = np.flatnonzero(key[label] != key)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(apart), cluster)), pa.array(key[label[apart]]), pa.array(key[apart])], ["cluster", "a", "b"]
        )

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, texts = None, [], []
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("cluster", "cell", "doc_id", "text")]
            for cluster, cell, doc_id, text in zip(*columns, strict=True):
                if (cluster, cell) != current:
                    if ids:
                        yield links(current[0], ids, texts)
                    current, ids, texts = (cluster, cell), [], []
                ids.append(doc_id)
                texts.append(text)
        if ids:
            yield links(current[0], ids, texts)

    return search


def _cells(members: DataFrame, lot: int) -> DataFrame:
    """Member rows with the cells they take part in: one, or for n > 1 lots each pair of lots."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / lot).cast("int").alias("lots"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("lots")).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), F.col("lots") - 1),
        lambda k: F.least(k, F.col("own")) * F.col("lots") + F.greatest(k, F.col("own")),
    )
    placed = members.join(sizes, "cluster").withColumn("own", own)
    return placed.select("doc_id", "cluster", "lots", F.explode(F.when(F.col("lots") == 1, F.array(F.lit(0))).otherwise(pair)).alias("cell"))


def jaccard_components(docs: DataFrame, percent: int = 90, words: int = 3, lot: int = LOT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id.

    `docs` has `doc_id` and `text`; other columns are ignored. A-Z are lower-cased; words are runs outside
    `[\\x20\\x09-\\x0D]`. A text's set holds its distinct shingles of `words` words; with fewer words, the
    whole sequence; a null text or one without words has an empty set and is linked with nothing.
    Texts link when 100 * intersection >= percent * union. component_id is the smallest doc_id reachable.
    A row without doc_id has no component (null). Rows that repeat a doc_id are one document: it
    links wherever one of its texts does. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    place = scratch_path(spark, "shingle_sets")
    kinds = "doc_id long, n_shingles long, set_1 long, set_2 long"
    wanted.mapInArrow(_describe(words), kinds).write.parquet(place)
    described = spark.read.parquet(place)
    # Documents and class representatives: a document's classes are its texts' equal sets.
    full = described.where("doc_id is not null and n_shingles > 0")
    classes = full.groupBy("set_1", "set_2", "n_shingles").agg(F.min("doc_id").alias("class"))
    classes = classes.withColumn("lot", F.xxhash64("set_1", "set_2"))
    same = ["lot", "set_1", "set_2", "n_shingles"]
    placed = scratch_path(spark, "classes")
    full.withColumn("lot", F.xxhash64("set_1", "set_2")).join(classes, same).select("doc_id", "class").distinct().write.parquet(placed)
    members = spark.read.parquet(placed)

    parts = buckets = max(shuffles, 2 * wanted.rdd.getNumPartitions())
    texts = wanted.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).repartition(parts, "part")
    sent = texts.mapInArrow(_send_shingles(words, buckets), "bucket int, part int, shingles binary")
    counted = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    answers = counted.mapInArrow(_count_shingles, "part int, bucket int, shingles binary, ranks binary").repartition(parts, "part")
    rarest = texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        _deal_rarest(words, percent, buckets), "bucket int, marks binary, docs binary"
    )
    edges = rarest.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_stars, "a long, b long").distinct()
    # Copies add nothing to a cluster: edges between the classes that the documents belong to.
    of = members.select(F.col("doc_id").alias("a"), F.col("class").alias("class_a"))
    to = members.select(F.col("doc_id").alias("b"), F.col("class").alias("class_b"))
    between = edges.join(of, "a").join(to, "b").where("class_a <> class_b")
    clusters = connected_components(between.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    cells_place = scratch_path(spark, "cells")
    _cells(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), lot).write.parquet(cells_place)
    cells = spark.read.parquet(cells_place)

    chosen = wanted.join(cells, "doc_id").select("cluster", "cell", "doc_id", "text")
    chosen = chosen.repartition(shuffles, "cluster", "cell").sortWithinPartitions("cluster", "cell", "doc_id")
    links_place = scratch_path(spark, "links")
    chosen.mapInArrow(_search(words, percent), "cluster long, a long, b long").write.parquet(links_place)
    links = spark.read.parquet(links_place)
    # Documents that share a class or are linked; several texts of one doc_id may bridge classes.
    bridges = members.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b"))
    graph = links.select("a", "b").union(bridges.where("a <> b").select("a", "b"))
    components = connected_components(graph).select(F.col("node").alias("class"), "component")
    of_document = members.join(components, "class", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "class")).alias("found")
    )
    return described.join(of_document, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id")
    )


def keep_one_per_component(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its component, with all their columns."""
    return drop_rows(docs, jaccard_components(docs, percent, words).where("component_id < doc_id"))
