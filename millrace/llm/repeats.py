"""Finding windows of symbols that start more than once in a corpus, each place of work bounded.

A window's anchor is the least hash of its short grams, so equal windows have equal anchors. Consecutive
windows of a text with one anchor form a run. Work is dealt out by anchor:

0. Anchors with many distinct runs are counted, on a sample of the runs. A passage in many documents makes
   them at its ends, where each document goes on differently. With such a hot anchor every window is a run of its
   own, and its anchor is the hash of the whole window: equal windows still agree, others part.
1. Texts are dealt into parts by a hash of their doc_id. Each part sends the hashes of its anchors, dealt
   into buckets; a bucket answers each part with the anchors that are not unique.
2. Each part sends its runs with such anchors to the shard of the anchor, each distinct run once, with its
   first place. However often a part repeats a passage, it sends it once.
3. A shard indexes its distinct runs and finds the earliest place of each of their windows. It answers the
   parts with stretches of windows and those places.
4. Each part applies the answers to every place at which it has a run, and writes its texts' results.

Parts, buckets and shards grow in number with the input. Texts are shuffled once and read from that
shuffle by steps 1, 2 and 4. Windows never cross texts. Texts of one doc_id keep an order of their own:
they count as one document whose texts follow one another.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import blocks

FLUSH = 1_000_000
#: An anchor with about so many distinct runs is hot.
HOT_RUNS = 10_000
#: Of the runs of an anchor that just counts as hot, about so many are in the sample.
HOT_SAMPLE = 128
#: A shard is indexed in so many slices of its anchors; sorting a few hundred kilobytes is cheapest per byte.
SLICES = 64
#: Documents without doc_id come after all others.
NO_ID = 2**63 - 1
#: A place is the number of a text among those of its doc_id, and the symbol in that text.
TEXT_SHIFT = 40


@dataclasses.dataclass(frozen=True)
class Rules:
    """How texts become symbols, and which windows count as repeats."""

    window: int
    gram: int
    #: bytes and offsets of a block -> symbols (to hash), hashes of grams, and where each text begins.
    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    pack: Callable[[np.ndarray], bytes]
    unpack: Callable[[bytes], np.ndarray]
    #: symbols, run starts, run windows -> the earliest place of every window, run after run.
    earliest: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    #: Whether an earlier start in the same document makes a window a repeat.
    within_document: bool
    #: block bytes, offsets, removed symbols, where each text begins -> result columns.
    result: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[pa.Array]]
    result_schema: str
    #: Bytes of texts that are hashed at a time.
    block: int = blocks.BLOCK_BYTES


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


@dataclasses.dataclass
class Runs:
    """Runs of a block: first symbol, number of windows, anchor, hash of their symbols, text and place."""

    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    text: np.ndarray

    def take(self, which: np.ndarray) -> Runs:
        return Runs(*(getattr(self, f.name)[which] for f in dataclasses.fields(self)))


def contents(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of stretches of symbols, wherever they stand."""
    return blocks.span_hash(blocks.prefix_sums(symbols.astype(np.uint64) + np.uint64(1)), starts, starts + lengths)


def find_runs(rules: Rules, symbols: np.ndarray, grams: np.ndarray, bounds: np.ndarray, hot: np.ndarray) -> Runs:
    """The runs of a block; `hot` are the hot anchors, ascending."""
    n, window = len(symbols), rules.window
    none = np.zeros(0, np.int64)
    if n < window:
        return Runs(none, none, none.view(np.uint64), none.view(np.uint64), none)
    least = sliding_least(grams, window - rules.gram + 1)
    ends = np.zeros(len(least) + 1, np.int32)  # windows that would reach into the next text
    lo, hi = (np.clip(x, 0, len(least)) for x in (np.maximum(bounds[1:] - window + 1, bounds[:-1]), bounds[1:]))
    np.add.at(ends, lo, 1)
    np.add.at(ends, hi, -1)
    valid = np.cumsum(ends)[:-1] == 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(first)
    place = np.flatnonzero(valid)
    at = np.searchsorted(place, start)
    windows = np.diff(np.append(at, len(place)))
    anchor = least[start]
    split = member(anchor, hot)
    if split.any():
        each = np.where(split, windows, 1)
        start, anchor = slices(start, each), np.repeat(anchor, each)
        windows, split = np.repeat(np.where(split, 1, windows), each), np.repeat(split, each)
    content = contents(symbols, start, windows + window - 1)
    anchor[split] = blocks.mix(content[split])
    text = np.searchsorted(bounds, start, side="right") - 1
    return Runs(start, windows, anchor, content, text)


def member(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which values are among the ascending ones."""
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def _sample_runs(rules: Rules, rate: int):
    """Anchor and content of one in `rate` distinct runs, the same ones wherever they stand."""
    none = np.zeros(0, np.uint64)

    def sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(none, none)]
            for _, _, data, offsets in blocks.blocks(batch.column(0), rules.block):
                runs = find_runs(rules, *rules.symbols(data, offsets), none)
                content = blocks.mix(runs.content)
                drawn = np.flatnonzero(content % np.uint64(rate) == 0)
                found.append((runs.anchor[drawn], content[drawn]))
            anchor, content = (np.concatenate([f[k] for f in found]) for k in range(2))
            _, one = np.unique(content, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(x[one].view(np.int64)) for x in (anchor, content)], ["anchor", "content"])

    return sample


def hot_anchors(docs: DataFrame, rules: Rules, runs: int) -> np.ndarray:
    """Anchors of about `runs` distinct runs or more, ascending: at most one for so many runs of the corpus.

    Which anchors are taken only decides how work is dealt out.
    """
    rate = max(1, runs // HOT_SAMPLE)
    drawn = docs.select("text").mapInArrow(_sample_runs(rules, rate), "anchor long, content long").distinct()
    found = drawn.groupBy("anchor").count().where(F.col("count") * rate >= runs).select("anchor").toArrow()
    return np.sort(found.column("anchor").combine_chunks().to_numpy().view(np.uint64))


def slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the given stretches, end to end."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def _anchors_within(rules: Rules, grams: np.ndarray, runs: Runs) -> np.ndarray:
    """How often each run's anchor occurs among its grams."""
    lengths = runs.windows + rules.window - rules.gram
    own = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(own[grams[slices(runs.start, lengths)] == runs.anchor[own]], minlength=len(lengths))


def _text_blocks(rules: Rules, texts: pa.Table, hot: np.ndarray) -> Iterator[tuple]:
    """A part's texts in order of doc_id (equal ones by text), in blocks with their runs.

    Yields row order, doc keys, number of each text within its doc_id, bytes, offsets, bounds and runs.
    """
    keys = texts.column("doc_id").fill_null(NO_ID).to_numpy()
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    again = np.flatnonzero(ordered[1:] == ordered[:-1])
    if len(again):
        values = texts.column("text").fill_null("")
        cut = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(order)]])
        for lo, hi in zip(cut.tolist(), cut[1:].tolist(), strict=False):
            if hi - lo > 1:
                order[lo:hi] = sorted(order[lo:hi].tolist(), key=lambda i: values[i].as_py())
    first = np.searchsorted(ordered, ordered)
    number = np.arange(len(order)) - first
    column = texts.column("text").combine_chunks() if texts.num_rows else pa.array([], pa.string())
    column = column.take(pa.array(order))
    for lo, hi, data, offsets in blocks.blocks(column, rules.block):
        symbols, grams, bounds = rules.symbols(data, offsets)
        runs = find_runs(rules, symbols, grams, bounds, hot)
        yield order[lo:hi], ordered[lo:hi], number[lo:hi], data, offsets, symbols, bounds, runs


def dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each hash, and 32 further bits of it: enough to tell most hashes of a bucket apart.

    Hashes that agree in both are taken for one. That is harmless where it only widens a choice, the same way
    everywhere.
    """
    return (hashes % np.uint64(buckets)).astype(np.int64), (hashes // np.uint64(buckets)).astype(np.uint32)


def keyed(bucket: np.ndarray | int, residual: np.ndarray) -> np.ndarray:
    """Bucket and residual as one number."""
    return (np.asarray(bucket).astype(np.uint64) << np.uint64(32)) + residual.astype(np.uint64)


def _send_anchors(rules: Rules, buckets: int, hot: np.ndarray):
    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            bucket, anchor = dealt(np.concatenate(held), buckets)
            part = np.concatenate(parts)
            held.clear(), parts.clear()
            order = np.lexsort((anchor, part, bucket))
            anchor, part, bucket = anchor[order], part[order], bucket[order]
            same = (anchor[1:] == anchor[:-1]) & (part[1:] == part[:-1])
            keep = np.concatenate([[True], ~same])
            twice = np.concatenate([same, [False]])[keep]
            anchor, part, bucket = anchor[keep], part[keep], bucket[keep]
            cut = np.concatenate([[0], np.flatnonzero((part[1:] != part[:-1]) | (bucket[1:] != bucket[:-1])) + 1, [len(part)]])
            rows = [(int(bucket[x]), int(part[x]), anchor[x:y].tobytes(), anchor[x:y][twice[x:y]].tobytes()) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["bucket", "part", "anchors", "twice"])

        for batch in batches:
            part = batch.column(2).to_numpy()
            for lo, hi, data, offsets in blocks.blocks(batch.column(1), rules.block):
                symbols, grams, bounds = rules.symbols(data, offsets)
                runs = find_runs(rules, symbols, grams, bounds, hot)
                held.append(runs.anchor)
                parts.append(part[lo:hi][runs.text])
                if rules.within_document:  # a run may repeat a window within itself: then it counts twice
                    inner = np.flatnonzero(_anchors_within(rules, grams, runs) > 1)
                    held.append(runs.anchor[inner])
                    parts.append(part[lo:hi][runs.text[inner]])
                if sum(map(len, held)) >= FLUSH:
                    yield flush()
        if sum(map(len, held)):
            yield flush()

    return send


def grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of each key; they come sorted by it."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != current and rows:
                yield rows
                rows = []
            current = row[key]
            rows.append(row)
    if rows:
        yield rows


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: to each part its anchors that are not unique."""
    for rows in grouped(batches, "bucket"):
        lists = [np.frombuffer(r["anchors"], np.uint32) for r in rows]
        every = np.concatenate(lists)
        owner = np.repeat([r["part"] for r in rows], [len(x) for x in lists])
        values, counts = np.unique(every, return_counts=True)
        twice = np.concatenate([values[counts > 1], *[np.frombuffer(r["twice"], np.uint32) for r in rows]])
        keep = np.isin(every, twice)
        every, owner = every[keep], owner[keep]
        order = np.argsort(owner, kind="stable")
        every, owner = every[order], owner[order]
        parts, begin = np.unique(owner, return_index=True)
        if len(parts):
            cut = np.append(begin, len(owner)).tolist()
            blobs = [every[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), pa.array([rows[0]["bucket"]] * len(parts), pa.int32()), pa.array(blobs, pa.binary())],
                ["part", "bucket", "anchors"],
            )


RUNS = "shard int, part int, doc binary, place binary, windows binary, more binary, cuts binary, symbols binary"


def _send_runs(rules: Rules, buckets: int, shards: int, hot: np.ndarray):
    def send(texts: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
        names = [c.split()[0] for c in RUNS.split(", ")]
        rows: list[tuple] = []
        lists = [keyed(r["bucket"], np.frombuffer(r["anchors"], np.uint32)) for r in answers.to_pylist()]
        wanted = np.unique(np.concatenate([np.zeros(0, np.uint64), *lists]))
        if not len(wanted) or not texts.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        part = texts.column("part")[0].as_py()
        found: list[tuple] = []
        held: list[np.ndarray] = []
        for _, keys, number, _, _, symbols, bounds, runs in _text_blocks(rules, texts, hot):
            key = keyed(*dealt(runs.anchor, buckets))
            at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            runs = runs.take(np.flatnonzero(wanted[at] == key))
            _, one, count = np.unique(runs.content, return_index=True, return_counts=True)
            runs = runs.take(one)
            place = (number[runs.text] << TEXT_SHIFT) + runs.start - bounds[runs.text]
            found.append((runs.content, keys[runs.text], place, runs.windows, count, runs.anchor))
            held.append(symbols[slices(runs.start, runs.windows + rules.window - 1)])
        content, doc, place, windows, count, anchor = (np.concatenate([f[k] for f in found]) for k in range(6))
        symbols = np.concatenate(held)
        # Blocks come in order of doc_id, so of equal runs the first stands for all.
        _, one, which = np.unique(content, return_index=True, return_inverse=True)
        more = np.bincount(which, weights=count).astype(np.int64) > 1
        begin = np.cumsum(windows + rules.window - 1) - (windows + rules.window - 1)
        cell = ((anchor[one] >> np.uint64(17)) % np.uint64(shards * SLICES)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        one, more, cell = one[order], more[order], cell[order]
        edges = np.searchsorted(cell, np.arange(shards * SLICES + 1))
        for shard in range(shards):
            cuts = edges[shard * SLICES : (shard + 1) * SLICES + 1]
            own = one[cuts[0] : cuts[-1]]
            if len(own):
                rows.append(
                    (shard, part, packed(doc[own]), packed(place[own]), packed(windows[own].astype(np.int32)),
                     packed(more[cuts[0] : cuts[-1]].astype(np.uint8)), packed((cuts - cuts[0]).astype(np.int32)),
                     rules.pack(symbols[slices(begin[own], windows[own] + rules.window - 1)]))
                )
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return send


#: Stretches of windows of a run and where the first of them starts first, columns end to end.
ANSWERS = "part int, content binary, first binary, last binary, doc binary, place binary"


def _slices_of(rules: Rules, rows: list[dict]) -> Iterator[tuple[np.ndarray, ...]]:
    """A shard's runs, one slice of its anchors at a time, so that an index stays small."""
    kinds = (("doc", np.int64), ("place", np.int64), ("windows", np.int32), ("more", np.uint8), ("cuts", np.int32))
    read = [[unpacked(r[c], t) for c, t in kinds] for r in rows]
    symbols = [rules.unpack(r["symbols"]) for r in rows]
    ends = [np.concatenate([[0], np.cumsum(x[2].astype(np.int64) + rules.window - 1)]) for x in read]
    for k in range(SLICES):
        spans = [(x[4][k], x[4][k + 1]) for x in read]
        if any(hi > lo for lo, hi in spans):
            columns = [np.concatenate([x[c][lo:hi] for x, (lo, hi) in zip(read, spans, strict=True)]) for c in range(4)]
            own = np.concatenate([s[e[lo] : e[hi]] for s, e, (lo, hi) in zip(symbols, ends, spans, strict=True)])
            part = np.repeat([r["part"] for r in rows], [hi - lo for lo, hi in spans])
            yield (*columns[:2], columns[2].astype(np.int64), columns[3].astype(bool), own, part)


def _search_shard(rules: Rules):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "shard"):
            # One answer to each part, from all slices.
            answers: dict[int, list[tuple[np.ndarray, ...]]] = {}
            for own in _slices_of(rules, rows):
                for part, columns in _answers(rules, *own):
                    answers.setdefault(part, []).append(columns)
            for part, found in answers.items():
                columns = (np.concatenate([f[k] for f in found]) for k in range(5))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), *[pa.array([packed(c)], pa.binary()) for c in columns]],
                    [c.split()[0] for c in ANSWERS.split(", ")],
                )

    return search


def _answers(
    rules: Rules, doc: np.ndarray, place: np.ndarray, windows: np.ndarray, more: np.ndarray, symbols: np.ndarray, part: np.ndarray
) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """For each part the stretches of its runs, from an index of the distinct runs given."""
    length = windows + rules.window - 1
    begin = np.cumsum(length) - length
    content = contents(symbols, begin, length)

    # One copy of each run, in order of its first place in the corpus.
    order = np.lexsort((place, doc))
    _, first, which = np.unique(content[order], return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))
    kept = order[np.sort(first)]
    run = np.empty(len(order), np.int64)
    run[order] = rank[which]
    copies = np.bincount(run)
    size = length[kept]
    text = symbols[slices(begin[kept], size)]
    base = np.cumsum(size) - size
    earliest = rules.earliest(text, base, windows[kept])

    # Stretches of windows whose earliest places follow one another in one run.
    own_window = np.repeat(np.arange(len(kept)), windows[kept])
    source = np.searchsorted(base, earliest, side="right") - 1
    begins = np.ones(len(earliest), bool)
    begins[1:] = (own_window[1:] != own_window[:-1]) | (source[1:] != source[:-1]) | (earliest[1:] != earliest[:-1] + 1)
    at = np.flatnonzero(begins)
    span = np.diff(np.append(at, len(earliest)))
    own, source = own_window[at], source[at]
    first_window = at - (np.cumsum(windows[kept]) - windows[kept])[own]
    from_doc = doc[kept][source]
    from_place = place[kept][source] + earliest[at] - base[source]
    stretches = np.bincount(own, minlength=len(kept))
    head = np.cumsum(stretches) - stretches
    # Runs that stand once in the corpus, each window being the first, need no answer.
    alone = np.bincount(own, weights=(source != own), minlength=len(kept)) == 0
    alone &= (copies == 1) & (stretches == 1)
    answer = np.flatnonzero(~alone[run] | more)
    if not len(answer):  # all runs of the slice stand alone
        return
    answer = answer[np.argsort(part[answer], kind="stable")]
    parts, cut = np.unique(part[answer], return_index=True)
    for p, x, y in zip(parts.tolist(), cut.tolist(), [*cut[1:].tolist(), len(answer)], strict=True):
        mine = answer[x:y]
        picked = slices(head[run[mine]], stretches[run[mine]])
        columns = (np.repeat(content[mine], stretches[run[mine]]), first_window[picked].astype(np.int32), (first_window[picked] + span[picked]).astype(np.int32), from_doc[picked], from_place[picked])
        yield p, columns


def _apply(rules: Rules, names: list[str], schema: pa.Schema, hot: np.ndarray):
    def apply(texts: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = (("content", np.uint64), ("first", np.int32), ("last", np.int32), ("doc", np.int64), ("place", np.int64))
        content, first, last, doc, place = (np.concatenate([np.zeros(0, t), *[unpacked(b, t) for b in answers.column(c).to_pylist()]]) for c, t in kinds)
        order = np.argsort(content, kind="stable")
        content, first, last, doc, place = (x[order] for x in (content, first, last, doc, place))
        out: list[pa.Table] = []
        for rows, keys, number, data, offsets, symbols, bounds, runs in _text_blocks(rules, texts, hot):
            lo = np.searchsorted(content, runs.content, side="left")
            many = np.searchsorted(content, runs.content, side="right") - lo
            which = np.repeat(np.arange(len(lo)), many)
            stretch = slices(lo, many)
            text = runs.text[which]
            own_doc, start = keys[text], runs.start[which]
            if rules.within_document:
                own_place = (number[text] << TEXT_SHIFT) + start - bounds[text] + first[stretch]
                gone = (doc[stretch] != own_doc) | (place[stretch] != own_place)
            else:
                gone = doc[stretch] < own_doc
            cover = np.zeros(len(symbols) + 1, np.int32)
            np.add.at(cover, start[gone] + first[stretch][gone], 1)
            np.add.at(cover, start[gone] + last[stretch][gone] + rules.window - 1, -1)
            removed = np.cumsum(cover)[:-1] > 0
            ids = texts.column("doc_id").take(pa.array(rows))
            columns = rules.result(data, offsets, removed, bounds)
            out.append(pa.table([ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, *columns], names))
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    return apply


def repeat_results(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id and the columns of `rules.result`, one row per row of `docs`."""
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(shuffles, 2 * wanted.rdd.getNumPartitions())
    buckets = shards = parts
    hot = hot_anchors(wanted, rules, HOT_RUNS)
    # Parts as numbers of their own, so that hashing them again for the shuffle keeps them whole.
    texts = wanted.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).repartition(parts, "part")

    anchors = texts.mapInArrow(_send_anchors(rules, buckets, hot), "bucket int, part int, anchors binary, twice binary")
    gathered = anchors.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    repeated = gathered.mapInArrow(_repeated, "part int, bucket int, anchors binary").repartition(parts, "part")
    runs = texts.groupBy("part").cogroup(repeated.groupBy("part")).applyInArrow(_send_runs(rules, buckets, shards, hot), RUNS)
    placed = runs.repartition(parts, "shard").sortWithinPartitions("shard")
    answers = placed.mapInArrow(_search_shard(rules), ANSWERS).repartition(parts, "part")
    schema = f"doc_id long, {rules.result_schema}"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_apply(rules, names, arrow, hot), schema)


def packed(values: np.ndarray) -> bytes:
    return compressed(np.ascontiguousarray(values).tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(restored(data), kind)


def compressed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def restored(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)
