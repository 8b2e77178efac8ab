"""Token ids as binary files of shuffled byte planes, written and read by Spark tasks.

A shard holds the ids of consecutive documents, in ascending doc_id order over all shards:

    magic | blocks | document table | index | length of the index (8 bytes) | magic

A block is `BLOCK_IDS` ids as 32-bit numbers (the last one shorter), transposed into four planes of
bytes: all lowest bytes, then all second bytes, and so on. Each plane is compressed by zstandard on its
own; a plane of zeros shrinks to some twenty bytes. The document table holds doc_ids and token counts,
transposed and compressed alike. The index is JSON: place and length of each plane of each block,
so a reader can take any range of ids without reading the rest.

Tasks write shards under names of their own into one shared folder and report them as rows; the rows are
saved by Spark as the manifest. Only shards named there are read, so a lost or repeated task leaves no
more than an unused file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import blocks
from millrace.llm.word_ids import with_end, word_ids
from millrace.sinks.scratch import scratch_path

MAGIC = b"MILLTOK1"
BLOCK_IDS = 1 << 16
MANIFEST = "shard int, file string, docs long, ids long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
READ_DOCS = 4096


def planes(values: np.ndarray, level: int = 1) -> list[bytes]:
    """The byte planes of little-endian numbers, each compressed."""
    bytes_of = values.view(np.uint8).reshape(len(values), values.itemsize)
    pack = zstandard.ZstdCompressor(level=level).compress
    return [pack(np.ascontiguousarray(bytes_of[:, k]).tobytes()) for k in range(values.itemsize)]


def unplanes(parts: list[bytes], dtype: str) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    columns = [np.frombuffer(unpack(p), np.uint8) for p in parts]
    return np.ascontiguousarray(np.stack(columns, axis=1)).view(dtype).reshape(-1)


def open_store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder given as a path or URI, and the path in it."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    if folder.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), folder
    return pyarrow.fs.FileSystem.from_uri(folder)


class ShardWriter:
    """Appends documents to one shard; holds at most a block of ids and the document table."""

    def __init__(self, sink) -> None:
        self._sink, self._place = sink, 0
        self._waiting: list[np.ndarray] = []
        self._held = 0
        self._index: list[list[tuple[int, int]]] = []
        self._docs: list[np.ndarray] = []
        self._counts: list[np.ndarray] = []
        self.ids = self.docs = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> tuple[int, int]:
        self._sink.write(data)
        self._place += len(data)
        return self._place - len(data), len(data)

    def _block(self, ids: np.ndarray) -> None:
        self._index.append([self._put(p) for p in planes(ids)])

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self._docs.append(np.asarray(doc_ids, "<i8"))
        self._counts.append(np.asarray(counts, "<i8"))
        self.docs, self.ids = self.docs + len(doc_ids), self.ids + len(ids)
        self._waiting.append(np.asarray(ids, "<u4"))
        self._held += len(ids)
        if self._held >= BLOCK_IDS:
            joined = np.concatenate(self._waiting)
            whole = len(joined) // BLOCK_IDS * BLOCK_IDS
            for k in range(0, whole, BLOCK_IDS):
                self._block(joined[k : k + BLOCK_IDS])
            self._waiting, self._held = [joined[whole:].copy()], len(joined) - whole

    def close(self) -> None:
        if self._held:
            self._block(np.concatenate(self._waiting))
        table = [[self._put(p) for p in planes(np.concatenate(x))] for x in (self._docs, self._counts)]
        index = json.dumps({"ids": self.ids, "block_ids": BLOCK_IDS, "blocks": self._index, "documents": table})
        _, length = self._put(zlib.compress(index.encode()))
        self._put(struct.pack("<Q", length) + MAGIC)
        self._sink.close()


class ShardReader:
    """Reads the document table, and any range of ids block by block."""

    def __init__(self, source) -> None:
        self._source = source
        size = source.size()
        tail = self._get(size - 16, 16)
        if tail[8:] != MAGIC or self._get(0, 8) != MAGIC:
            raise ValueError("not a shard, or a shard cut short")
        length = struct.unpack("<Q", tail[:8])[0]
        self._index = json.loads(zlib.decompress(self._get(size - 16 - length, length)))
        docs, counts = ([self._get(*p) for p in x] for x in self._index["documents"])
        self.doc_ids, self.counts = unplanes(docs, "<i8"), unplanes(counts, "<i8")
        self._cached = (-1, np.zeros(0, np.uint32))

    def _get(self, place: int, length: int) -> bytes:
        self._source.seek(place)
        return self._source.read(length)

    def _block(self, number: int) -> np.ndarray:
        if self._cached[0] != number:
            parts = [self._get(*p) for p in self._index["blocks"][number]]
            self._cached = (number, unplanes(parts, "<u4"))
        return self._cached[1]

    def ids(self, start: int, end: int) -> np.ndarray:
        size, parts = self._index["block_ids"], []
        while start < end:
            number, at = divmod(start, size)
            take = min(end - start, size - at)
            parts.append(self._block(number)[at : at + take])
            start += take
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


#: Stands for a null doc_id in a shard; such documents come first, as nulls sort first.
NO_ID = -(2**63)


def _writer(folder: str, path: str, end_id: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        shard = TaskContext.get().partitionId()
        name = f"{shard:08d}-{uuid.uuid4().hex}.tok"
        out = None
        for batch in batches:
            keys = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in blocks.blocks(batch.column(1)):
                if out is None:
                    store, root = open_store(folder)
                    store.create_dir(root, recursive=True)
                    out = ShardWriter(store.open_output_stream(f"{root}/{name}"))
                ids, bounds = with_end(*encoder.encode(data, offsets), end_id)
                out.add(keys[lo:hi], np.diff(bounds), ids)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "file": [name], "docs": pa.array([out.docs], pa.int64()), "ids": pa.array([out.ids], pa.int64())}
            )

    return write


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Write the ids of all documents below `folder` in ascending doc_id order; returns the manifest.

    `docs` has `doc_id` and `text`; other columns are ignored. `end_id` follows each document's ids, so
    a null or empty text has one id. Rows are ordered by doc_id (nulls first), equal doc_ids by
    text. `shards` defaults to the partitions of the input, at least the session's shuffle partitions.
    An empty table gives an empty manifest. The manifest is saved in the folder, so this runs once.
    """
    spark = docs.sparkSession
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = shards or max(wanted.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = wanted.repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    manifest = f"{folder.rstrip('/')}/manifest"
    ordered.mapInArrow(_writer(f"{folder.rstrip('/')}/shards", path, end_id), MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def _reader(folder: str):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as source:
                    shard = ShardReader(source)
                    bounds = np.concatenate([[0], np.cumsum(shard.counts)])
                    for lo in range(0, len(shard.doc_ids), READ_DOCS):
                        hi = min(lo + READ_DOCS, len(shard.doc_ids))
                        crc = []
                        for k in range(lo, hi):
                            crc.append(zlib.crc32(memoryview(shard.ids(int(bounds[k]), int(bounds[k + 1]))).cast("B")))
                        keys = pa.array(shard.doc_ids[lo:hi], mask=shard.doc_ids[lo:hi] == NO_ID)
                        yield pa.RecordBatch.from_arrays(
                            [keys, pa.array(row["before"] + bounds[lo:hi]), pa.array(shard.counts[lo:hi]), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return read


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the shards in the manifest: doc_id, start, n_tokens, ids_crc32.

    `start` is the number of ids of all documents before it. The offsets of shards come from one sum
    over the manifest, which has one short row per shard.
    """
    folder = folder.rstrip("/")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "file", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    spread = placed.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard")
    return spread.mapInArrow(_reader(f"{folder}/shards"), DOCUMENTS)


def token_files(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write all documents to a fresh folder in the shared place and read them back from the files."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token_files")
    write_token_files(docs, folder, path, end_id)
    return read_token_files(spark, folder)
