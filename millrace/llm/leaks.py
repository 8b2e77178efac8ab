"""Benchmark passages in documents: q-gram lemma filtering in diagonal bands, then banded alignment.

Both sides are lower-cased (A-Z) with white space runs as one space, and compared as UTF-8 bytes. An item
is cut into overlapping probes. A region within e edits of a probe of length m shares at least
m - q + 1 - q*e of its q-grams, all on diagonals (text place minus probe place) that differ by at most
e. So shared q-grams are counted per probe in overlapping bands of diagonals; bands with fewer are
dismissed, without loss, and the others are aligned within the band.

The items are a query set run against all rows, in blocks of bounded size: each block is indexed once and
shipped to the tasks, which stream whole texts past it. Documents are not shuffled.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import blocks
from millrace.llm.exact import normalise
from millrace.llm.rows import drop_rows

Q = 9
PROBE = 80
STRIDE = 40
#: Edits allowed per byte of a probe. 9 * 0.08 < 1, so the lemma always leaves q-grams to count.
EDITS = 0.08
#: Items shorter than this after normalisation identify nothing and are not searched.
SHORTEST = 30
BLOCK_BYTES = 1 << 20
FILTER_BITS = 22
#: Pairs of q-grams counted, and windows aligned, at once.
PAIRS = 1 << 20
WINDOWS = 1 << 13
LEAKS = "doc_id long, item_id long, probes long, distance long, place long"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def gram_codes(data: np.ndarray) -> np.ndarray:
    """A 64-bit code of the `Q` bytes at every place."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((n,), "<u8", np.ascontiguousarray(data).data, 0, (1,)).astype(np.uint64)
    eight *= np.uint64(0x9E3779B97F4A7C15)
    eight += data[Q - 1 :].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return eight ^ (eight >> np.uint64(29))


def _slots(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - FILTER_BITS)


@dataclasses.dataclass(frozen=True)
class ProbeIndex:
    """Probes of a block of items, and which of their q-grams stand where."""

    items: list[dict[int, int]]  # of each probe: the numbers of its items, and how often it stands in each
    texts: list[bytes]  # different ones
    lengths: np.ndarray
    budgets: np.ndarray
    least: np.ndarray  # shared q-grams that a region needs
    codes: np.ndarray  # distinct codes, ascending
    first: np.ndarray  # place of each code's first entry, and the end
    probe: np.ndarray  # entries
    place: np.ndarray

    @staticmethod
    def build(texts: list[str | None]) -> ProbeIndex:
        owners: dict[bytes, dict[int, int]] = {}
        for number, text in enumerate(texts):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            plain = normalise(_LOWER[raw], np.array([0, len(raw)]))[0].tobytes().strip(b" ")
            if len(plain) < SHORTEST:
                continue
            starts = sorted({*range(0, len(plain) - PROBE, STRIDE), max(0, len(plain) - PROBE)})
            for start in starts:
                own = owners.setdefault(plain[start : start + PROBE], {})
                own[number] = own.get(number, 0) + 1
        probes = list(owners)
        lengths = np.array([len(p) for p in probes], np.int64)
        budgets = (lengths * EDITS).astype(np.int64)
        grams = [gram_codes(np.frombuffer(p, np.uint8)) for p in probes]
        codes = np.concatenate([np.zeros(0, np.uint64), *grams])
        probe = np.repeat(np.arange(len(probes)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])
        order = np.argsort(codes, kind="stable")
        distinct, first = np.unique(codes[order], return_index=True)
        return ProbeIndex(
            list(owners.values()), probes, lengths, budgets, lengths - Q + 1 - Q * budgets, distinct,
            np.append(first, len(codes)), probe[order], place[order],
        )


def banded_distance(probe: np.ndarray, windows: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between `probe` and any part of each window, and where that part ends.

    Row i of the table holds window places i to i + width: as windows are little longer than the probe, that
    is the whole band. Places that are not `valid` match nothing and cannot be skipped.
    """
    m, width = len(probe), windows.shape[1] - len(probe) + 1
    far = np.int32(1 << 20)
    step = np.arange(width, dtype=np.int32)
    # Place k of row i stands for the boundary before window place i + k; a part may begin anywhere.
    row = np.zeros((len(windows), width), np.int32)
    for i in range(m):
        here, usable = windows[:, i : i + width], valid[:, i : i + width]
        both = np.where(usable, row + (here != probe[i]), far)
        down = np.full_like(row, far)
        down[:, :-1] = row[:, 1:] + 1
        best = np.minimum(both, down)
        # Extra bytes of the text: along the row, one edit each, over usable places only.
        walls = np.cumsum(~usable, axis=1).astype(np.int32) * np.int32(1 << 12)
        row = np.minimum(np.minimum.accumulate(best - step - walls, axis=1) + step + walls, far)
    ends = row.argmin(axis=1)
    return row[np.arange(len(row)), ends], ends + m


def _band_counts(
    index: ProbeIndex, hits: np.ndarray, at: np.ndarray, text: np.ndarray, half: int, bands: int
) -> tuple[np.ndarray, np.ndarray]:
    """Shared q-grams per text, probe and half band of diagonals, as ascending keys and their counts.

    A q-gram that repeats in a text and in a probe pairs each place with each, so pairs are counted a bounded number at a time.
    """
    many = index.first[at + 1] - index.first[at]
    upto = np.cumsum(many)
    cuts = np.unique(np.searchsorted(upto, np.arange(0, int(many.sum()) + PAIRS, PAIRS)))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo, hi in zip(cuts, [*cuts[1:], len(many)], strict=True):
        part = many[lo:hi]
        entry = np.repeat(index.first[at[lo:hi]] - np.cumsum(part) + part, part) + np.arange(part.sum())
        diagonal = np.repeat(hits[lo:hi], part) - index.place[entry] + PROBE  # never negative
        owner = np.repeat(text[lo:hi], part) * len(index.texts) + index.probe[entry]
        found.append(np.unique(owner * bands + diagonal // half, return_counts=True))
    if len(found) == 2:
        return found[1]
    keys, which = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return keys, np.bincount(which, weights=np.concatenate([f[1] for f in found]), minlength=len(keys)).astype(np.int64)


def find_regions(index: ProbeIndex, raw: np.ndarray, raw_offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matching (text, probe, distance, place in the normalised text) of a block."""
    data, offsets = normalise(_LOWER[raw], raw_offsets)
    nothing = (np.zeros(0, np.int64),) * 4
    codes = gram_codes(data)
    if not len(codes) or not len(index.codes):
        return nothing
    table = _filter(index)
    hits = np.flatnonzero(table[_slots(codes)])
    at = np.searchsorted(index.codes, codes[hits])
    at[at == len(index.codes)] = 0
    same = index.codes[at] == codes[hits]
    hits, at = hits[same], at[same]
    text = np.searchsorted(offsets, hits, side="right") - 1
    inside = hits + Q <= offsets[text + 1]
    hits, at, text = hits[inside], at[inside], text[inside]
    half = int(PROBE * EDITS) + 1
    bands = int((len(data) + 2 * PROBE) // half + 2)
    keys, counts = _band_counts(index, hits, at, text, half, bands)
    if not len(keys):
        return nothing
    both = counts.copy()
    neighbours = keys[1:] == keys[:-1] + 1
    both[:-1][neighbours] += counts[1:][neighbours]
    leading = np.ones(len(keys), bool)  # a band whose left half is empty is the next key's own
    probe = keys // bands % len(index.texts)
    leading &= both >= index.least[probe]
    keys = keys[leading]
    probe, text, band = keys // bands % len(index.texts), keys // bands // len(index.texts), keys % bands

    out: list[tuple] = []
    for m in np.unique(index.lengths[probe]).tolist():
        mine = np.flatnonzero(index.lengths[probe] == m)
        edits = int(m * EDITS)
        start = band[mine] * half - PROBE - edits
        size = m + 2 * half + 2 * edits
        for number in np.unique(probe[mine]).tolist():
            every = np.flatnonzero(probe[mine] == number)
            for lo in range(0, len(every), WINDOWS):
                own, begin = mine[every[lo : lo + WINDOWS]], start[every[lo : lo + WINDOWS]]
                places = begin[:, None] + np.arange(size)
                valid = (places >= offsets[text[own]][:, None]) & (places < offsets[text[own] + 1][:, None])
                windows = data[np.clip(places, 0, len(data) - 1)]
                distance, end = banded_distance(np.frombuffer(index.texts[number], np.uint8), windows, valid)
                good = distance <= edits
                out.append((text[own][good], np.full(good.sum(), number), distance[good], begin[good] + end[good] - offsets[text[own][good]]))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(4)) if out else nothing


_filters: dict[int, tuple[ProbeIndex, np.ndarray]] = {}


def _filter(index: ProbeIndex) -> np.ndarray:
    """Which hash slots the index's q-grams fall into; kept for the index in use."""
    kept = _filters.get(id(index))
    if kept is None:
        table = np.zeros(1 << FILTER_BITS, bool)
        table[_slots(index.codes)] = True
        _filters.clear()
        kept = _filters[id(index)] = (index, table)
    return kept[1]


def _searcher(index: ProbeIndex, item_ids: list[int | None]):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in blocks.blocks(batch.column(1)):
                text, probe, distance, place = find_regions(index, data, offsets)
                if not len(text):
                    continue
                best: dict[tuple[int, int], list[int]] = {}
                seen = set()
                for t, p, d, at in sorted(zip(text.tolist(), probe.tolist(), distance.tolist(), place.tolist(), strict=True), key=lambda r: (r[2], r[3])):
                    for item, times in index.items[p].items():
                        row = best.setdefault((t, item), [0, d, at])
                        row[0] += times if (t, p) not in seen else 0
                    seen.add((t, p))
                columns = [[item_ids[i] for _, i in best], *([v[k] for v in best.values()] for k in range(3))]
                ids = batch.column(0).take(pa.array([lo + t for t, _ in best]))
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "item_id", "probes", "distance", "place"]
                )

    return search


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row and benchmark item that share a passage: doc_id, item_id, probes (how many of
    the item's probes are found), distance (least edits of one) and place (where its region ends).

    `docs` has `doc_id` and `text`, `benchmark` has `item_id` and `text`; other columns are ignored. Null and
    empty texts, and items shorter than `SHORTEST` bytes, match nothing; null ids stay null; repeated
    rows are searched each; an empty table gives no rows. Equal distances: the earliest place.
    """
    spark = docs.sparkSession
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes)
    found = []
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
        index = ProbeIndex.build([r["text"] for r in rows])
        if len(index.texts):
            found.append(wanted.mapInArrow(_searcher(index, [r["item_id"] for r in rows]), LEAKS))
    if not found:
        return spark.createDataFrame([], LEAKS)
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return every


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without a benchmark passage, with all their columns; rows without doc_id stay."""
    return drop_rows(docs, find_leaks(docs, benchmark))
