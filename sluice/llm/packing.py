"""Best-fit packing of token sequences by hierarchical residual packing.

Documents become token ids (the tokenizer's ids of the whole text, then an end id); longer ones are cut into
pieces of `capacity` tokens.  Full pieces are sequences as they are.  The rest are packed in rounds: each
partition packs its items best-fit, largest first, closes bins that are nearly full, and passes underfull
bins on as items; partitions merge by a fixed fan-in until one is left.  A bin is never taken apart, and a
placement is a link from an item to its bin and offset, so a round moves a few numbers per item.  A partition
passes at most `carry` bins upward, the emptiest; the fuller ones are closed as they are, so no task grows
with the input and no piece is lost.

Defined cases: a null text counts as empty and makes one piece, the end id alone; repeated rows are packed
each for themselves; an empty table gives no sequence; extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import kept, text_slices, written

CAPACITY = 4096
END_ID = 1
FAN_IN = 8
FULL = 0.995
CARRY = 100_000
#: Items a task packs in the first round; more to choose from make fuller bins.
PER_TASK = 50_000
#: Distinct words a worker remembers the ids of.
CACHE = 450_000
#: Bytes of text encoded at a time.
SLICE = 4 << 20
#: Words tokenized at a time.
LEARN = 8_000
#: ASCII marks that form one piece after a letter or digit; an apostrophe may begin a contraction.
MARKS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")


class WordTokens:
    """Ids of texts by a tokenizer whose pieces never cross a blank or line feed, word by remembered word."""

    def __init__(self, path: str, cache: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache or CACHE
        self.place: dict[bytes, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.used = np.zeros(0, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        """Remember the ids of new words.  A tail of ASCII marks after a letter or digit is tokenized apart from its stem."""
        tails = {w: (stem, w[len(stem) :]) for w in new if (stem := w.rstrip(MARKS)) is not w and stem and stem[-1] in ALNUM and b"<|" not in w}
        parts = {p for pair in tails.values() for p in pair}
        self._ask(list(parts.union(w for w in new if w not in tails).difference(self.place)))
        pairs = np.array([(self.place[a], self.place[b]) for a, b in tails.values()], np.int64).reshape(-1, 2).ravel()
        # ids of the joined words: those of the stem, then those of the tail
        sizes = self.sizes[pairs]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[pairs] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self._add(list(tails), sizes.reshape(-1, 2).sum(axis=1), ids)

    def _ask(self, words: list[bytes]) -> None:
        for i in range(0, len(words), LEARN):
            got = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[i : i + LEARN]], add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            self._add(words[i : i + LEARN], sizes, np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())))

    def _add(self, words: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        # the tokenizer lower-cases all but special tokens
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        words = list(chain.from_iterable(split))
        if len(self.place) > self.cache:
            self._forget()
        if new := list(set(words).difference(self.place)):
            self._learn(new)
        codes = np.fromiter(map(self.place.__getitem__, words), np.int32, len(words))
        self.used = np.concatenate([self.used, np.zeros(len(self.sizes) - len(self.used), np.int64)]) + np.bincount(codes, minlength=len(self.sizes))
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.starts[codes] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.cumsum(counts)]
        return flat, np.diff(bounds, prepend=0)

    def _forget(self) -> None:
        """Keep the half of the words that were used most."""
        words = list(self.place)
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.cache // 2])
        sizes = self.sizes[keep]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(self.starts[keep] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        self.place = {words[i]: n for n, i in enumerate(keep.tolist())}
        self.starts, self.sizes, self.used = ends - sizes, sizes, self.used[keep] // 2


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, cache: int | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every piece of every document.

    A worker remembers `cache` words (default CACHE) and encodes `slice_bytes` of text at a time: fewer take less memory, more time.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(f"words of {path}, {cache}", lambda: WordTokens(path, cache))
        for batch, texts in text_slices(batches, max_bytes=slice_bytes):
            flat, sizes = coder.encode(texts)
            at, out = 0, []
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
                ids = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                out += [(doc_id, k, s, min(capacity, n + 1 - s), crc32(ids[s : s + capacity])) for k, s in enumerate(range(0, n + 1, capacity))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit, largest first: bin and offset of each item, and the fill of each bin."""
    bins, offsets, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms = 0  # bit r is set if some bin has r left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + ((fitting & -fitting).bit_length() - 1)
            b = open_at[room].pop()
            if not open_at[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if left := room - size:
            open_at[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def pack(items: DataFrame, capacity: int = CAPACITY, fan_in: int = FAN_IN, full: float = FULL, carry: int = CARRY, per_task: int = PER_TASK) -> DataFrame:
    """Items (item long, size long) to (item, sequence_id, offset)."""

    def round_of(level: int, last: bool):  # noqa: ANN202
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            part = int(pdf["part"].iloc[0])
            pdf = pdf.sort_values(["size", "item"], ascending=[False, True])
            bins, offsets, fills = best_fit(pdf["size"].to_numpy(), capacity)
            open_bins = np.flatnonzero(fills < full * capacity) if not last else np.zeros(0, np.int64)
            closed = np.ones(len(fills), bool)
            closed[open_bins[np.argsort(fills[open_bins], kind="stable")][:carry]] = False
            name = (np.int64(level + 1) << 56) + (np.int64(part) << 32) + np.arange(len(fills))
            return pd.DataFrame({"item": pdf["item"].to_numpy(), "bin": name[bins], "offset": offsets, "fill": fills[bins], "closed": closed[bins]})

        return run

    schema = "item long, bin long, offset long, fill long, closed boolean"
    level, parts = 0, max(1, -(-items.count() // per_task))
    placed = None
    now = items.select(F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int").alias("part"), "item", "size")
    while True:
        last = parts == 1
        done = written(now.groupBy("part").applyInPandas(round_of(level, last), schema), f"pack{level}")
        step = done.select("item", "bin", "offset", "closed")
        if placed is None:
            placed = step
        else:  # an item whose bin has become an item moves on with it
            moved = step.select(F.col("item").alias("bin"), F.col("bin").alias("new"), F.col("offset").alias("more"), F.col("closed").alias("now_closed"))
            open_now = placed.where(~F.col("closed")).join(moved, "bin").select("item", F.col("new").alias("bin"), (F.col("offset") + F.col("more")).alias("offset"), F.col("now_closed").alias("closed"))
            placed = placed.where("closed").unionByName(open_now)
        if last:
            return placed.select("item", F.col("bin").alias("sequence_id"), "offset")
        open_bins = done.where(~F.col("closed")).groupBy("bin").agg(F.max("fill").alias("size"))
        parts = -(-parts // fan_in)
        level += 1
        # the bin's name holds the partition it came from: neighbours merge
        now = open_bins.select((F.shiftright(F.col("bin"), 32).bitwiseAND(F.lit((1 << 24) - 1)) / fan_in).cast("int").alias("part"), F.col("bin").alias("item"), "size")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, cache: int | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """Every piece with its sequence_id and offset there."""
    cut = written(pieces(docs, path, capacity, end_id, cache, slice_bytes).withColumn("item", F.monotonically_increasing_id()), "pieces")
    whole = cut.where(F.col("length") == capacity).select("*", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < capacity)
    places = pack(rest.select("item", F.col("length").alias("size")), capacity)
    return whole.unionByName(rest.join(places, "item").select(*cut.columns, "sequence_id", "offset")).drop("item")
