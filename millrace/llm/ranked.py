"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, with a score interval per document.

The documents' postings of the items' terms are saved first, in shards of bounded size, with the counts that the
weights need. Once these are summed over the corpus, each shard's lists are sorted by impact, and every item
reads its lists in step, from the highest impacts down. A document's lower bound is what has been read of
it, its upper bound adds the last impact read in each list where it has not been met. An item is done in a
shard when the intervals of its best documents have closed and no other document can reach them, ties included;
the best of all shards are then ranked by Spark.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import blocks
from millrace.sinks.scratch import scratch_path

#: Bytes of terms: ASCII digits and letters, and all others than ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: A shard ends with the document that brings it to so many postings, or to so many documents.
SHARD_POSTINGS = 1_000_000
SHARD_DOCS = 50_000
#: Items are searched in blocks of about so many bytes, a scan of the documents each.
BLOCK_BYTES = 4 << 20
#: Postings read per list in the first round; each later round reads four times as many.
FIRST_DEPTH = 256
NO_ID = 2**63 - 1

SHARD = "docs long, terms long, frequencies binary, ids binary, lengths binary, owners binary, words binary, counts binary"
FOUND = "item long, doc_id long, score long"


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def term_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of one stretch of bytes."""
    inside = TERM[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edges = np.concatenate([[0], edges])
    if len(edges) % 2:
        edges = np.concatenate([edges, [len(data)]])
    return edges[::2], edges[1::2]


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of a column's texts in stretches of a few megabytes: row and start of each text or part of one.

    Longer texts are cut before a byte that is in no term. A text of one endless term stays whole.
    """
    for lo, hi, data, offsets in blocks.blocks(column):
        if hi - lo > 1 or len(data) <= 2 * blocks.BLOCK_BYTES:
            yield np.arange(lo, hi), offsets, data
            continue
        begin = 0
        while begin < len(data):
            end = begin + blocks.BLOCK_BYTES
            while end < len(data) and TERM[data[end]]:
                gap = np.flatnonzero(~TERM[data[end : end + 65536]])
                end = end + int(gap[0]) if len(gap) else min(end + 65536, len(data))
            yield np.array([lo]), np.array([0, min(end, len(data)) - begin]), data[begin:end]
            begin = end


def term_keys(terms: list[str]) -> np.ndarray:
    """64-bit keys of terms, as the texts' terms get them."""
    raw = [t.encode() for t in terms]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    return blocks.span_hash(blocks.prefix_hash(data), starts, starts + sizes)


class _Shard:
    """Postings of consecutive documents, until they are enough for a shard."""

    def __init__(self, terms: int) -> None:
        self.terms = terms
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.lengths = np.zeros(0, np.int64)
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.postings = 0

    def add(self, ids: list[int | None], lengths: np.ndarray, owners: np.ndarray, words: np.ndarray, again: bool) -> None:
        """Documents with their lengths; `again`: the first of them is the last one added, gone on."""
        first = len(self.ids) - 1 if again else len(self.ids)
        if again:
            self.lengths[-1] += lengths[0]
        else:
            self.ids += ids
            self.lengths = np.concatenate([self.lengths, lengths])
        keys, counts = np.unique((owners + first) * self.terms + words, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.postings += len(keys)

    def full(self) -> bool:
        return self.postings >= SHARD_POSTINGS or len(self.ids) >= SHARD_DOCS

    def row(self) -> pa.RecordBatch:
        """The shard's row; documents without a term leave no trace."""
        keys, which = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(which, weights=np.concatenate(self.counts)).astype(np.int64)
        owners, words = keys // self.terms, keys % self.terms
        some, owners = np.unique(owners, return_inverse=True)
        ids = np.array([NO_ID if i is None else i for i in self.ids], np.int64)[some]
        nulls = np.array([self.ids[i] is None for i in some.tolist()], bool)
        frequencies = np.bincount(words, minlength=self.terms)
        values: list[tuple[object, pa.DataType]] = [
            (int((self.lengths > 0).sum()), pa.int64()),
            (int(self.lengths.sum()), pa.int64()),
            (_packed(frequencies), pa.binary()),
            (_packed(np.concatenate([ids, nulls.astype(np.int64)])), pa.binary()),
            (_packed(self.lengths[some]), pa.binary()),
            (_packed(owners.astype(np.int32)), pa.binary()),
            (_packed(words.astype(np.int32)), pa.binary()),
            (_packed(counts.astype(np.int32)), pa.binary()),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], [c.split()[0] for c in SHARD.split(", ")])


def _index(keys: np.ndarray):
    """Shards of the postings of the terms with these keys, ascending."""

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(max(1, len(keys)))
        for batch in batches:
            last = -1
            for rows, offsets, data in pieces(batch.column(1)):
                lower = _LOWER[data]
                # Blocks lie end to end: a byte of no term is set between texts.
                cuts = offsets[1:-1]
                spaced = np.insert(lower, cuts, 0x20)
                moved = offsets + np.concatenate([np.arange(len(offsets) - 1), [max(0, len(offsets) - 2)]])
                starts, ends = term_spans(spaced)
                owners = np.searchsorted(moved[1:-1], starts, side="right")
                lengths = np.bincount(owners, minlength=len(rows))
                hashes = blocks.span_hash(blocks.prefix_hash(spaced), starts, ends)
                at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
                hit = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
                again = len(rows) == 1 and int(rows[0]) == last
                if shard.full() and not again:
                    yield shard.row()
                    shard.clear()
                ids = batch.column(0).slice(int(rows[0]), len(rows)).to_pylist()
                shard.add(ids, lengths, owners[hit], at[hit], again)
                last = int(rows[-1])
        if shard.ids:
            yield shard.row()

    return index


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """`(1000000000 * tf) div (1000 * tf + 8 * m)` with `m = 10 + (90 * n * docs) div terms`."""
    if int(n.max(initial=0)) * 90 * docs < 2**63:
        m = 10 + (90 * n * docs) // terms
    else:
        m = np.array([10 + (90 * int(x) * docs) // terms for x in n.tolist()], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Lists:
    """A shard's lists: per term its documents by falling impact, already times the term's weight."""

    def __init__(self, ids: np.ndarray, owners: np.ndarray, words: np.ndarray, gains: np.ndarray, terms: int) -> None:
        order = np.lexsort((owners, -gains, words))
        self.ids, self.owners, self.gains = ids, owners[order], gains[order]
        self.begin = np.searchsorted(words[order], np.arange(terms + 1))

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (as numbers of `ids`) and exact scores of the `k` best, equal scores by ascending id."""
        begin, end = self.begin[terms], self.begin[terms + 1]
        some = end > begin
        begin, end = begin[some], end[some]
        lower = np.zeros(len(self.ids), np.int64)
        missing = np.ones((len(begin), len(self.ids)), bool)
        depth, step, floor, alive = 0, FIRST_DEPTH, 0, None
        while True:
            for t in range(len(begin)):
                # A document stands once in a list.
                read = slice(int(begin[t]) + depth, int(min(begin[t] + depth + step, end[t])))
                lower[self.owners[read]] += self.gains[read]
                missing[t, self.owners[read]] = False
            depth, step = depth + step, step * 4
            # The most that a document not yet met in a list can still get from it.
            left = np.where(begin + depth < end, self.gains[np.minimum(begin + depth, end) - 1], 0)
            known = lower[lower > 0] if alive is None else lower[alive]
            if len(known) >= k:  # the k-th best lower bound
                floor = int(np.partition(known, len(known) - k)[len(known) - k])
            if not left.any():
                alive = np.flatnonzero(lower) if alive is None else alive
                break
            if left.sum() >= floor:
                continue  # a document that no list has shown yet may be among the best
            alive = np.flatnonzero(lower) if alive is None else alive
            upper = lower[alive] + (left.astype(np.float64) @ missing[:, alive]).astype(np.int64)
            alive, upper = alive[upper >= floor], upper[upper >= floor]
            if (upper == lower[alive]).all():
                break
        order = np.lexsort((self.ids[alive], -lower[alive]))[:k]
        return alive[order], lower[alive][order]


def _search(items: list[np.ndarray], weights: np.ndarray, docs: int, terms: int, k: int):
    """The `k` best documents of each shard for each item (an array of term numbers)."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, nulls = np.split(_unpacked(row["ids"], np.int64), 2)
                lengths = _unpacked(row["lengths"], np.int64)
                owners, words = _unpacked(row["owners"], np.int32), _unpacked(row["words"], np.int32)
                tf = _unpacked(row["counts"], np.int32).astype(np.int64)
                gains = weights[words] * impacts(tf, lengths[owners], docs, terms)
                lists = Lists(ids, owners, words, gains, len(weights))
                found = [(i, *lists.best(own, k)) for i, own in enumerate(items)]
                item = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
                which = np.concatenate([np.zeros(0, np.int64), *[f[1] for f in found]])
                score = np.concatenate([np.zeros(0, np.int64), *[f[2] for f in found]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item), pa.array(ids[which], mask=nulls[which] > 0), pa.array(score)], ["item", "doc_id", "score"]
                )

    return search


def _search_block(docs: DataFrame, rows: list[tuple[int | None, str]], k: int) -> DataFrame:
    """The ranked documents of one block of items; rows of one id are one item."""
    spark = docs.sparkSession
    by_item: dict[int | None, set[str]] = {}
    for item, text in rows:
        lowered = text.translate({c: c + 0x20 for c in range(0x41, 0x5B)})
        by_item.setdefault(item, set()).update(_TERMS.findall(lowered))
    words = sorted(set().union(*by_item.values()))
    keys = term_keys(words) if words else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    number = {words[i]: n for n, i in enumerate(order.tolist())}

    place = scratch_path(spark, "postings")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_index(keys[order]), SHARD).write.parquet(place)
    shards = spark.read.parquet(place)
    sums = shards.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    with_term, all_terms = sums["docs"] or 0, sums["terms"] or 0
    df = _frequencies(shards, len(words))
    weights = np.array([math.floor(1000 * math.log((2 * with_term + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)
    items = [np.array(sorted(number[t] for t in own), np.int64) for own in by_item.values()]
    found = shards.select(*[c.split()[0] for c in SHARD.split(", ")]).mapInArrow(_search(items, weights, with_term, all_terms, k), FOUND)
    place_in_item = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.where("score > 0").withColumn("rank", place_in_item).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(by_item)), "item long, item_id long")
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def _frequencies(shards: DataFrame, terms: int) -> np.ndarray:
    """Documents per term: each task adds up its shards, so the driver gets one row per task."""

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(terms, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                own += _unpacked(blob, np.int64)[:terms]
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], ["term", "docs"])

    summed = shards.select("frequencies").mapInArrow(total, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    rows = summed.toArrow()
    out = np.zeros(terms, np.int64)
    out[rows.column("term").to_numpy()] = rows.column("docs").to_numpy()
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The `k` documents of highest score for each item: item_id, rank (from 1), doc_id and score.

    `docs` has `doc_id` and `text`, `items` has `item_id` and `text`; other columns are ignored. Terms are maximal runs of
    ASCII letters (A-Z lower-cased), digits and characters beyond ASCII, in whole texts. With N documents that have
    terms, L terms in all, n terms in a document, df documents with a term and tf occurrences in a document, the
    score adds up, for the item's distinct terms, `floor(1000 ln((2N + 2) / (2 df + 1)))` times
    `(10^9 tf) div (1000 tf + 8 m)`, where `m = 10 + (90 n N) div L`. Equal scores: ascending doc_id, null last.

    Rows of `items` that share an id (null too) are one item with the terms of all of them. Rows of `docs` that share an id are
    documents of their own. Null and empty texts have no terms; an item without terms that occur has no rows,
    and neither have empty tables.

    Items are taken in blocks of about `block_bytes`, chosen by a hash of their id; each block scans the documents
    once, and its terms and weights go to all tasks. An item must fit in memory as a whole.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    places = []
    for part in range(parts):
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        if not own:
            continue
        found = _search_block(docs, [(r["item_id"], r["text"]) for r in own], k)
        if parts == 1:
            return found
        places.append(scratch_path(spark, "ranked"))
        found.write.parquet(places[-1])
    if not places:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, [spark.read.parquet(p) for p in places])
