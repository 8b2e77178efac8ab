"""Phrase collocations from count streams kept in prefix order and in suffix order.

1. Texts become chunks: numbers of words into a list of the chunk's own words, with marks where pieces begin.
2. Words are counted over all chunks. A phrase can't be more frequent than its words, so those below the threshold
   leave here, exactly; the others get a number that all chunks share.
3. Chunks count their phrases of frequent words and deal the sorted counts into buckets, which add them up.
4. The counts are two streams, one in the order of phrases read from their first word on, one from their last word.
   In the first a phrase meets its left parts and its extensions to the right, in the second its right parts and
   its extensions to the left: merge joins of sorted streams, without hash tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import blocks
from millrace.sinks.scratch import scratch_path

UNKNOWN = "und"
#: A chunk ends with the text that brings a task's held words to so many.
CHUNK_WORDS = 3_000_000
#: Before the best phrases of a language meet, they are picked in so many lots.
LOTS = 64
#: About so many phrases of a length are added up in one bucket.
BUCKET_PHRASES = 4_000_000

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

CHUNKS = "lang string, n long, words array<string>, counts array<long>, codes binary, begins binary"
PARTIAL = "bucket int, size int, lang string, ids binary, counts binary"
COUNTED = "lang string, ids array<long>, a long"
#: A word's number is that of the chunk where it stands first, moved by so many bits, and its place in that chunk's list.
LIST_BITS = 26


def _packed(values: np.ndarray) -> bytes:
    """Compressed by byte planes: the high bytes of small numbers cost nothing."""
    plane = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(plane).tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    plane = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(plane.T).reshape(-1).view(kind)


def _stretches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """Rows, bytes and offsets of blocks of texts; a long text comes in stretches cut between words.

    The last value tells a stretch that goes on with the text of the one before.
    """
    for lo, hi, data, offsets in blocks.blocks(column):
        if hi - lo > 1 or len(data) <= 2 * blocks.BLOCK_BYTES:
            yield lo, hi, data, offsets, False
            continue
        begin = 0
        while begin < len(data):
            end = begin + blocks.BLOCK_BYTES
            while end < len(data) and not _GAP[data[end]]:
                gap = np.flatnonzero(_GAP[data[end : end + 65536]])
                end = end + int(gap[0]) if len(gap) else end + 65536
            end = min(end, len(data))
            yield lo, hi, data[begin:end], np.array([0, end - begin]), begin > 0
            begin = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and piece of every word of a block; pieces are numbered from 0 and end with their text."""
    solid = ~_GAP[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets[1:-1]] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    texts = np.searchsorted(offsets[1:-1], starts, side="right")
    # Breaks before a word and texts before it.
    pieces = np.searchsorted(np.flatnonzero(_BREAK[data]), starts) + texts
    return starts, ends, texts, pieces


class _Held:
    """Words of one language, until they are enough for a chunk."""

    def __init__(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.begins: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.words: list[bytes] = []

    def row(self, lang: str) -> tuple:
        every = np.concatenate(self.keys)
        keys, one = np.unique(every, return_index=True)
        codes = np.searchsorted(keys, np.concatenate(self.hashes)).astype(np.int32)
        words = [self.words[i].decode() for i in one.tolist()]
        counts = np.bincount(codes, minlength=len(keys))
        begins = np.packbits(np.concatenate(self.begins))
        return lang, len(codes), words, counts, _packed(codes), zstandard.ZstdCompressor(level=1).compress(begins.tobytes())


def _encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, _Held] = {}
    kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary())
    total, open_piece = 0, -1

    def flush() -> Iterator[pa.RecordBatch]:
        for lang in sorted(held):
            row = held[lang].row(lang)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])
        held.clear()

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, hi, raw, offsets, again in _stretches(batch.column(1)):
            if total >= CHUNK_WORDS and not again:
                yield from flush()
                total = 0
            data = _LOWER[raw]
            starts, ends, texts, pieces = words_of(data, offsets)
            begins = np.ones(len(starts), bool)
            begins[1:] = pieces[1:] != pieces[:-1]
            if again and len(starts):
                # The first word goes on with the piece that the last stretch left open, unless a break lies between.
                begins[0] = open_piece < 0 or bool(_BREAK[data[: starts[0]]].any())
            if len(starts):
                open_piece = -1 if _BREAK[data[ends[-1] :]].any() else 0
            elif not again or _BREAK[data].any():
                open_piece = -1
            hashes = blocks.span_hash(blocks.prefix_hash(data), starts, ends)
            whole = data.tobytes()
            number = {lang: k for k, lang in enumerate(dict.fromkeys(langs[lo:hi]))}
            of_text = np.array([number[x] for x in langs[lo:hi]], np.int64)
            for lang, k in number.items():
                own = np.flatnonzero(of_text[texts] == k) if len(number) > 1 else np.arange(len(starts))
                if not len(own):
                    continue
                keys, one = np.unique(hashes[own], return_index=True)
                at = held.setdefault(lang, _Held())
                at.hashes.append(hashes[own])
                at.begins.append(begins[own])
                at.keys.append(keys)
                at.words += [whole[starts[i] : ends[i]] for i in own[one].tolist()]
            total += len(starts)
    yield from flush()


def phrase_counts(codes: np.ndarray, begins: np.ndarray, ids: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, ids (a column per word) and counts of all phrases of 2 to `longest` words.

    `codes` are places in `ids`; words without an id (-1) are in no phrase.
    """
    known = ids[codes] >= 0
    current = np.where(known, codes.astype(np.int64), -1)
    columns = ids[None, :]
    for size in range(2, longest + 1):
        # Phrase i goes on with the word after it, which must be in the same piece.
        following = codes[size - 1 :]
        at = np.flatnonzero((current[: len(following)] >= 0) & known[size - 1 :] & ~begins[size - 1 :]) if len(following) else np.zeros(0, np.int64)
        key = current[at] * len(ids) + following[at]
        found, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        columns = np.concatenate([columns[:, found // max(1, len(ids))], ids[None, found % max(1, len(ids))]])
        yield size, columns, counts
        current = np.full(len(current), -1, np.int64)
        current[at] = inverse


def _count(buckets: int, longest: int):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                lang = row.column(0)[0].as_py()
                codes = _unpacked(row.column(1)[0].as_py(), np.int32)
                marks = zstandard.ZstdDecompressor().decompress(row.column(2)[0].as_py())
                begins = np.unpackbits(np.frombuffer(marks, np.uint8), count=len(codes)).astype(bool)
                ids = np.full(int(row.column(3)[0].as_py()), -1, np.int64)
                answers = row.column(4)[0].values
                ids[answers.field("place").to_numpy()] = answers.field("id").to_numpy()
                for size, columns, counts in phrase_counts(codes, begins, ids, longest):
                    if not len(counts):
                        continue
                    mixed = reduce(lambda h, c: blocks.mix(h + c.view(np.uint64)), columns, np.zeros(len(counts), np.uint64))
                    bucket = (mixed % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                    some = np.flatnonzero(np.diff(cuts))
                    for lo in range(0, len(some), 64):
                        part = some[lo : lo + 64].tolist()
                        own = [order[cuts[b] : cuts[b + 1]] for b in part]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(part, pa.int32()),
                                pa.array([size] * len(part), pa.int32()),
                                pa.array([lang] * len(part), pa.string()),
                                pa.array([_packed(columns[:, o].reshape(-1)) for o in own], pa.binary()),
                                pa.array([_packed(counts[o]) for o in own], pa.binary()),
                            ],
                            [c.split()[0] for c in PARTIAL.split(", ")],
                        )

    return count


def _add_up(least: int):
    """Counts of the phrases of each bucket, from its rows in order of bucket, length and language."""

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist())
        for (_, size, lang), own in groupby(rows, key=lambda r: (r["bucket"], r["size"], r["lang"])):
            ids: list[np.ndarray] = []
            counts: list[np.ndarray] = []
            for row in own:
                ids.append(_unpacked(row["ids"], np.int64).reshape(size, -1))
                counts.append(_unpacked(row["counts"], np.int64))
            columns, every = np.concatenate(ids, axis=1), np.concatenate(counts)
            order = np.lexsort(columns[::-1])
            columns = columns[:, order]
            first = np.concatenate([[True], (columns[:, 1:] != columns[:, :-1]).any(axis=0)])
            at = np.flatnonzero(first)
            sums = np.add.reduceat(every[order], at)
            keep = sums >= least
            flat = columns[:, at[keep]].T.reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * int(keep.sum()), pa.string()), lists, pa.array(sums[keep])], ["lang", "ids", "a"])

    return add_up


def _saved(df: DataFrame, label: str) -> DataFrame:
    place = scratch_path(df.sparkSession, label)
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def count_streams(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts (lang, ids, a) of the phrases of up to `longest` words that occur `least` times or more, the
    words of the ids (id, word), and the words of each language in all (lang, n)."""
    spark = docs.sparkSession
    wanted = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    # Chunk numbers: the task and the row in it, as the file has them once it is written.
    row = F.monotonically_increasing_id()
    number = F.shiftleft(F.shiftright(row, 33), 16) + row.bitwiseAND(F.lit(0xFFFF))
    chunks = _saved(wanted.mapInArrow(_encode, CHUNKS).withColumn("chunk", number), "chunks")
    totals = chunks.groupBy("lang").agg(F.sum("n").alias("n"))

    listed = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "one"))
    listed = listed.select("chunk", "lang", "place", F.col("one.words").alias("word"), F.col("one.counts").alias("count"))
    same = Window.partitionBy("lang", "word")
    own = F.shiftleft("chunk", LIST_BITS) + F.col("place")
    known = listed.select("chunk", "lang", "word", "place", own.alias("own"), F.sum("count").over(same).alias("a"), F.min(own).over(same).alias("id"))
    known = _saved(known.where(F.col("a") >= least), "known_words")
    words = known.where(F.col("id") == F.col("own")).select("lang", "id", "word", "a")

    answers = known.groupBy("chunk").agg(F.collect_list(F.struct("place", "id")).alias("answers"))
    answered = chunks.select("chunk", "lang", "codes", "begins", F.size("words").alias("size")).join(answers, "chunk")
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = chunks.agg(F.sum("n")).first()[0] or 0
    buckets = max(shuffles, -(-total // BUCKET_PHRASES))
    counted = answered.select("lang", "codes", "begins", "size", "answers").mapInArrow(_count(buckets, longest), PARTIAL)
    dealt = counted.repartition(buckets, "bucket").sortWithinPartitions("bucket", "size", "lang")
    single = words.select("lang", F.array("id").alias("ids"), "a")
    grams = _saved(dealt.mapInArrow(_add_up(least), COUNTED).unionByName(single), "phrase_counts")
    return grams, words.select("id", "word"), totals


def cut_scores(grams: DataFrame) -> DataFrame:
    """ids, lang, a, and l, r and score of the lowest-scoring cut (of equal ones the first) of each phrase of two words or more.

    score is `floor(1000000 * a * a / (l * r))`, in exact decimals.
    """
    size = F.size("ids")
    phrases = grams.where(size > 1)
    cuts = phrases.select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("ids", F.lit(1), F.col("k")), "tail": F.slice("ids", F.col("k") + 1, size - F.col("k"))})
    # Prefix order: a phrase comes with its left part; suffix order: with its right part.
    left = grams.select(F.col("ids").alias("head"), F.col("a").alias("l")).hint("merge")
    right = grams.select(F.reverse("ids").alias("reversed"), F.col("a").alias("r")).hint("merge")
    joined = cuts.join(left, "head").withColumn("reversed", F.reverse("tail")).join(right, "reversed")
    wide = "decimal(19,0)"
    score = F.expr(f"(cast(a as {wide}) * cast(a as {wide}) * cast(1000000 as decimal(7,0))) div (cast(l as {wide}) * cast(r as {wide}))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return joined.groupBy("lang", "ids", "a").agg(lowest).select("lang", "ids", "a", "cut.l", "cut.r", "cut.score")


def extension_counts(grams: DataFrame) -> DataFrame:
    """ids and longer: the count of a phrase's most frequent extension by one word, to either side."""
    size = F.size("ids")
    long = grams.where(size > 2)
    prefixes = long.groupBy(F.slice("ids", F.lit(1), size - 1).alias("ids")).agg(F.max("a").alias("longer"))
    suffixes = long.groupBy(F.slice("ids", F.lit(2), size - 1).alias("ids")).agg(F.max("a").alias("longer"))
    return prefixes.unionByName(suffixes).groupBy("ids").agg(F.max("longer").alias("longer"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, contained_percent: int = 50, top: int = 2000) -> DataFrame:
    """The `top` phrases of each language: lang, rank (from 1), phrase, a, l, r, n and score.

    `docs` has `text` and `lang`; other columns are ignored, and a null lang is `und`. Texts are lower-cased (A-Z) and split at
    `[.,;:!?\\x0A-\\x0D]` into pieces, these into words `[^\\x20\\x09]+`. A candidate is a phrase of 2 to `longest` words
    with `least` or more occurrences (a) within pieces, overlaps included. Its score is the lowest over its cuts in two,
    `floor(1000000 a a / (l r))` with l and r the occurrences of the parts; of equal cuts the first counts. Candidates
    are dropped that lie within a longer one with `contained_percent` of their occurrences or more. n counts the
    language's words. Order: score, then a, falling, then the phrase by its bytes. Null and empty texts have no
    words; repeated rows count each; an empty table gives no rows.

    A phrase within a longer one is within one of its extensions by one word, which are as frequent or more, so only
    these are looked at.
    """
    grams, words, totals = count_streams(docs, longest, least)
    longer = extension_counts(grams).hint("merge")
    scored = cut_scores(grams).join(longer, "ids", "left")
    kept = scored.where(F.coalesce(100 * F.col("longer") < contained_percent * F.col("a"), F.lit(True)))
    # Ties stay until the phrases are known. The best of all are among the best of each lot.
    order = (F.desc("score"), F.desc("a"))
    lots = kept.withColumn("lot", F.pmod(F.xxhash64("ids"), F.lit(LOTS)))
    picked = lots.withColumn("near", F.rank().over(Window.partitionBy("lang", "lot").orderBy(*order))).where(F.col("near") <= top)
    near = F.rank().over(Window.partitionBy("lang").orderBy(*order))
    best = _saved(picked.withColumn("near", near).where(F.col("near") <= top).drop("near", "lot", "longer"), "best_phrases")
    spelled = best.select("ids", F.posexplode("ids").alias("place", "id")).join(words, "id").groupBy("ids")
    phrase = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]))
    named = best.join(spelled.agg(phrase.alias("phrase")), "ids").join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = named.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
