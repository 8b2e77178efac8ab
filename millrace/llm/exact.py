"""Exact duplicates by content-defined chunk recipes.

Texts are compared after replacing every run of `[\\x20\\x09-\\x0D]` by one space. Each normalised text is
cut into chunks where a hash of its last 16 bytes says so, so equal texts have equal cuts. The bytes
of a chunk travel once per task to the place of their 64-bit address; there, chunks of one address are
compared byte by byte, and each distinct one gets a verified identifier. From then on a text is its
recipe, the ordered list of its chunks' identifiers, and texts are equal when their recipes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import blocks
from millrace.llm.rows import fresh
from millrace.sinks.scratch import scratch_path

#: A chunk ends where the low bits of the rolling hash are zero: 1 KiB on average, 64 KiB at most.
CUT_MASK = np.uint32((1 << 10) - 1)
LONGEST = 1 << 16
ROLL = 16

CHUNKS = "address long, chunk binary, doc_ids array<long>, shas array<binary>, positions array<int>, copies array<int>"
PARTS = "doc_id long, sha binary, position int, identifier string, copies int"


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with each run of white space as one space."""
    if not len(data):
        return data, offsets
    blank = blocks.SPACE[data]
    again = np.zeros(len(data), bool)
    again[1:] = blank[1:] & blank[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    again[begins] = False
    upto = np.concatenate([[0], np.cumsum(~again)])
    return np.where(blank, np.uint8(0x20), data)[~again], upto[offsets]


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending ends and starts of all chunks of a block; every text's ends are among them."""
    rolled = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    span = 1
    while span < ROLL and len(rolled) > span:
        rolled = rolled[:-span] * np.uint32((0x85EBCA6B ** span) & 0xFFFFFFFF | 1) + rolled[span:]
        rolled ^= rolled >> np.uint32(15)
        span *= 2
    ends = np.flatnonzero((rolled & CUT_MASK) == 0) + ROLL if span == ROLL else np.zeros(0, np.int64)
    owner = np.searchsorted(offsets, ends, side="left") - 1
    ends = ends[ends - offsets[owner] >= ROLL]  # the hash must not reach into the text before
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes > LONGEST)
    forced = [offsets[i] + np.arange(LONGEST, sizes[i], LONGEST) for i in long]
    return np.unique(np.concatenate([ends, offsets, *forced]))


def _chunker(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct chunk of a group of blocks once, with the documents and places it stands at."""
    for batch in batches:
        for lo, hi, raw, raw_offsets in blocks.blocks(batch.column(1)):
            data, offsets = normalise(raw, raw_offsets)
            keys = batch.column(0).slice(lo, hi - lo)
            whole = data.tobytes()
            shas = [hashlib.sha256(whole[offsets[i] : offsets[i + 1]]).digest() for i in range(hi - lo)]
            # Rows that agree in doc_id and text are one document with a number of copies.
            copies: dict[tuple, int] = {}
            first: dict[tuple, int] = {}
            for i, key in enumerate(zip(keys.to_pylist(), shas, strict=True)):
                copies[key] = copies.get(key, 0) + 1
                first.setdefault(key, i)
            bounds = chunk_bounds(data, offsets)
            starts, ends = bounds[:-1], bounds[1:]
            address = blocks.span_hash(blocks.prefix_hash(data), starts, ends).view(np.int64)
            rows: dict[tuple[int, bytes], list] = {}
            for (doc_id, sha), i in first.items():
                a, b = np.searchsorted(bounds, offsets[i]), np.searchsorted(bounds, offsets[i + 1])
                places = range(int(a), int(b)) if b > a else [None]
                for position, k in enumerate(places):
                    chunk = b"" if k is None else whole[starts[k] : ends[k]]
                    row = rows.setdefault((0 if k is None else int(address[k]), chunk), [[], [], [], []])
                    for into, value in zip(row, (doc_id, sha, position, copies[doc_id, sha]), strict=True):
                        into.append(value)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in rows], pa.int64()),
                        pa.array([k[1] for k in rows], pa.binary()),
                        pa.array([r[0] for r in rows.values()], pa.list_(pa.int64())),
                        pa.array([r[1] for r in rows.values()], pa.list_(pa.binary())),
                        pa.array([r[2] for r in rows.values()], pa.list_(pa.int32())),
                        pa.array([r[3] for r in rows.values()], pa.list_(pa.int32())),
                    ],
                    ["address", "chunk", "doc_ids", "shas", "positions", "copies"],
                )


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by address and chunk: equal neighbours are one chunk, others of the address a new one."""
    address, chunk, variant = None, b"", 0
    for batch in batches:
        chunks, addresses = batch.column(1).to_pylist(), batch.column(0).to_pylist()
        names = []
        for a, c in zip(addresses, chunks, strict=True):
            if a != address:
                address, chunk, variant = a, c, 0
            elif c != chunk:
                chunk, variant = c, variant + 1
            names.append(f"{a & 0xFFFFFFFFFFFFFFFF:016x}" + (f".{variant}" if variant else ""))
        lists = [batch.column(k) for k in range(2, 6)]
        sizes = np.diff(lists[0].offsets.to_numpy())
        which = pa.array(np.repeat(np.arange(len(names)), sizes))
        yield pa.RecordBatch.from_arrays(
            [lists[0].flatten(), lists[1].flatten(), lists[2].flatten(), pa.array(names).take(which), lists[3].flatten()],
            ["doc_id", "sha", "position", "identifier", "copies"],
        )


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, sha (of the normalised text), copies and recipe: one row per distinct (doc_id, text)."""
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = wanted.mapInArrow(_chunker, CHUNKS)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = chunks.repartition(partitions, "address").sortWithinPartitions("address", "chunk")
    parts = ordered.mapInArrow(_verify, PARTS)
    listed = F.array_sort(F.collect_set(F.struct("position", "identifier")))
    by_doc = parts.groupBy("doc_id", "sha").agg(
        listed.alias("__list"), F.sum(F.when(F.col("position") == 0, F.col("copies"))).alias("copies")
    )
    return by_doc.select("doc_id", "sha", "copies", F.transform("__list", lambda x: x["identifier"]).alias("recipe"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    `docs` has `doc_id` and `text`; other columns are ignored. A null text counts as empty. Of equal texts
    the row with the smallest doc_id stays; of several such rows, one. Null doc_ids come after all
    others. text_sha256 is the lowercase hex digest of the normalised text. An empty table gives no rows.

    The recipes are saved in the shared folder first. A group of any size is summed before it is
    shuffled, and joined back by a join of two shuffled sides that Spark can split.
    """
    spark = docs.sparkSession
    place = scratch_path(spark, "recipes")
    recipes(docs).write.parquet(place)
    saved = spark.read.parquet(place).withColumn("lot", F.xxhash64("recipe"))
    groups = saved.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = groups.select(F.xxhash64("recipe").alias("lot"), "recipe", "keep_id", "group_size")
    joined = saved.join(groups, ["lot", "recipe"])
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return joined.select("doc_id", "keep_id", "group_size", F.hex("sha").alias("sha"), copy).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Rows are told apart by doc_id and normalised text, so of rows that agree in both one stays.
    """
    key, sha, own = (fresh(docs.columns, name) for name in ("kept_id", "kept_sha", "own_sha"))
    stay = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    marked = docs.withColumn(own, F.sha2(F.encode(text, "UTF-8"), 256))
    same = marked["doc_id"].cast("long").eqNullSafe(stay[key]) & (marked[own] == stay[sha])
    return marked.join(stay, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)
