"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a zstandard raw-content dictionary of excerpts of its texts. A text is cut into pieces of some
kilobytes, each piece is compressed with every dictionary, and the sizes of all pieces are added up, so
that text of any length is judged as a whole and long texts don't outgrow the dictionaries.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import blocks

#: A text without a language.
UNKNOWN = "und"
PIECE_BYTES = 4096
LEVEL = 6
#: A text whose best size is not smaller than the next by this share is rejected.
LEAST_MARGIN = 0.02
#: Sizes that differ by this share of the smallest are e times less likely.
SCALE = 0.02
#: So many times the wanted texts are drawn by hash, before the least hashes among them are taken.
OVERDRAW = 8

_ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: A-Z lower-cased, other ASCII bytes but a-z blank; bytes of other characters stay.
_PLAIN = bytes((c | 0x20) if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

SCORED = "doc_id long, lang_pred string, score double, margin double, rejected boolean"


def plain(piece: bytes) -> bytes:
    """Letters in lower case, with one space for what is between them."""
    return b" ".join(piece.translate(_PLAIN).split())


def has_letter(text: bytes) -> bool:
    if _ASCII_LETTER.search(text):
        return True
    return not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "ignore")))


class Compressors:
    """One compressor per language, each with the language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL) -> None:
        self.langs = sorted(dictionaries)
        self._compress = []
        for lang in self.langs:
            own = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=level)
            self._compress.append(
                zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_dict_id=False).compress
            )

    def sizes(self, text: bytes, piece_bytes: int = PIECE_BYTES) -> list[int]:
        """Compressed bytes of the whole text per language."""
        total = [0] * len(self.langs)
        for at in range(0, len(text), piece_bytes):
            piece = plain(text[at : at + piece_bytes])
            for k, compress in enumerate(self._compress):
                total[k] += len(compress(piece))
        return total


def judge(sizes: list[int]) -> tuple[int, float, float]:
    """Number of the smallest size (the first of equal ones), its likelihood and its margin to the next."""
    best = min(range(len(sizes)), key=sizes.__getitem__)
    least = sizes[best]
    score = 1 / sum(np.exp((least - size) / (SCALE * least)) for size in sizes)
    others = [s for k, s in enumerate(sizes) if k != best]
    margin = 1 - least / min(others) if others else 1.0
    return best, float(score), float(margin)


def _identify(dictionaries: dict[str, bytes], least_margin: float):
    def identify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Compressors(dictionaries)
        for batch in batches:
            for lo, hi, data, offsets in blocks.blocks(batch.column(1)):
                raw, rows = data.tobytes(), []
                for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    text = raw[begin:end]
                    if not own.langs or not has_letter(text):
                        rows.append((UNKNOWN, 0.0, 0.0, True))
                        continue
                    best, score, margin = judge(own.sizes(text))
                    rows.append((own.langs[best], score, margin, margin < least_margin))
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], [c.split()[0] for c in SCORED.split(", ")])

    return identify


def fit_dictionaries(labelled: DataFrame, texts: int = 256, excerpt: int = 512) -> dict[str, bytes]:
    """A dictionary per language: excerpts of `excerpt` characters of at most `texts` different texts of that language.

    `labelled` has `text` and `lang`; rows without either are left out. The texts are those of least hash, and the
    hash also says where the excerpt begins, so neither copies nor the order of rows count. At most
    `OVERDRAW * texts` excerpts of a language are shuffled, about, and `texts` reach the driver.
    """
    known = labelled.where("lang is not null and text is not null and text <> ''").select("lang", "text")
    counts = known.groupBy("lang").count().collect()  # one row per language
    if not counts:
        return {}
    # A language's share of texts to draw, in parts of 2**31.
    shares = {r["lang"]: int(min(1.0, OVERDRAW * texts / r["count"]) * 2**31) for r in counts}
    share = reduce(lambda case, one: case.when(F.col("lang") == one[0], one[1]), list(shares.items())[1:], F.when(F.col("lang") == list(shares)[0], list(shares.values())[0]))
    key = F.xxhash64("text")
    drawn = known.withColumn("key", key).where(F.pmod("key", F.lit(2**31)) < share)
    start = F.pmod(F.shiftright("key", 31), F.greatest(F.length("text") - excerpt, F.lit(1))) + 1
    cut = drawn.select("lang", "key", F.col("text").substr(start.cast("int"), F.lit(excerpt)).alias("cut"))
    distinct = cut.groupBy("lang", "key").agg(F.min("cut").alias("cut"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(2**31)), "key"))
    kept = distinct.withColumn("place", place).where(F.col("place") <= texts).select("lang", "place", "cut").collect()
    pieces: dict[str, list[bytes]] = {}
    for row in sorted(kept, key=lambda r: (r["lang"], r["place"])):
        pieces.setdefault(row["lang"], []).append(plain(row["cut"].encode()))
    # zstandard takes raw content of eight bytes or more.
    return {lang: b"\n".join(own).ljust(8) for lang, own in pieces.items()}


def identify_languages(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = LEAST_MARGIN) -> DataFrame:
    """One row per row of `docs`: doc_id, lang_pred, score, margin and rejected.

    `docs` has `doc_id` and `text`; other columns are ignored. The language is the one whose dictionary compresses the
    whole text to the fewest bytes; of equal ones, the first by name. score (0 to 1) is its likelihood among
    the languages, margin the share by which the next is larger, and rejected tells a margin below
    `least_margin`. Null and empty texts, and those without a letter, are `und` with score 0, and rejected; so is
    every text if there are no dictionaries. Null and repeated ids are kept as they are; an empty table
    gives no rows.
    """
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return wanted.mapInArrow(_identify(dictionaries, least_margin), SCORED)
