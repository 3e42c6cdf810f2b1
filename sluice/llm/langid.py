"""Language identification by compression.

A raw-content zstandard dictionary is made for each language from training texts.  A text is compressed
with every dictionary, in whole (long texts piece by piece, sizes added), and gets the language whose
dictionary leaves the fewest bytes.  `rejected` marks a choice whose margin to the second is narrow.

Dictionaries come from at most `sample` documents a language (smallest hash of doc_id), each giving one slice of
DICT_BYTES / their number bytes (at least 256) from a hashed place of its whole text: documented bounds of the fit, and
no place of the texts is preferred.  Every row is classified, and whole.  Defined cases: a null text or one without any letter is `und`, score 0;
without training texts every text is `und`; a repeated training row counts once, an id with several texts in one
language with the smallest slice; ties go to the language first in alphabetical order; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import text_slices

SAMPLE = 256
DICT_BYTES = 64 << 10
PIECE = 1 << 10
LEVEL = 12
MARGIN = 0.01
#: ASCII letters are lower-cased, bytes of other characters stay, all else becomes a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain(text: bytes) -> bytes:
    return b" ".join(text.translate(_TABLE).split())


def has_letter(text: bytes, plain_text: bytes) -> bool:
    return not plain_text.isspace() and (any(97 <= b <= 122 for b in plain_text[:64]) or any(c.isalpha() for c in text.decode("utf-8", "replace")))


def part_of(text: bytes, share: int, seed: int) -> bytes:
    """`share` bytes of the plain text from a hashed place on, from a word's start where there is one; all of a shorter text."""
    small = plain(text)
    if len(small) <= share:
        return small
    at = crc32(b"%d" % seed) % (len(small) - share + 1)
    at = small.find(b" ", at) + 1 if at and small.find(b" ", at, at + share // 2) >= 0 else at
    return small[at : at + share]


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict[str, bytes]:
    """A dictionary for each non-null lang of docs."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang").distinct()
    # ranked within salted parts of a language first, so that a common language is not one task's
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id"))
    parts = known.withColumn("part", F.pmod(F.hash("doc_id"), F.lit(64))).withColumn("rank", rank("lang", "part")).where(F.col("rank") <= sample)
    chosen = parts.withColumn("rank", rank("lang")).where(F.col("rank") <= sample).drop("part")
    chosen = chosen.withColumn("n", F.count("*").over(Window.partitionBy("lang")))
    # bounded: sample rows a language, each with the share that its dictionary takes; slices are cut in the tasks
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in text_slices(batches):
            slices = [part_of(t, max(256, DICT_BYTES // n), i) for t, n, i in zip(raw, batch.column("n").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), pa.array(slices, pa.binary())], names=["lang", "rank", "part"])

    slices = texts.mapInArrow(cut, "lang string, rank int, part binary").groupBy("lang", "rank").agg(F.min("part").alias("part"))
    by: dict[str, list[bytes]] = {}
    for r in slices.orderBy("lang", "rank").collect():
        if r["part"]:
            by.setdefault(r["lang"], []).append(bytes(r["part"]))
    return {lang: d for lang, ts in sorted(by.items()) if len(d := b" ".join(ts)[-DICT_BYTES:]) >= 8}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(dictionaries)
        self.coders = []
        for lang in self.langs:
            held = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        pieces = [text] if len(text) <= PIECE else [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.coders]

    def classify(self, text: bytes | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is narrow."""
        small = plain(text or b"")
        if not text or not self.langs or not has_letter(text, small):
            return "und", 0.0, True
        sizes = self.sizes(small)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], 1.0, False
        gaps = np.array(sizes, float) - sizes[best]
        share = float(1 / np.exp(-gaps / max(1.0, 0.01 * sizes[best])).sum())
        second = min(g for i, g in enumerate(gaps) if i != best)
        return self.langs[best], share, bool(second < MARGIN * sizes[best])


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected, in place of columns of these names."""
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)
    names = ["lang_pred", "lang_score", "lang_rejected"]
    schema = docs.withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0), "lang_rejected": F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(held.value)
        for batch, texts in text_slices(batches):
            got = [judge.classify(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)
