"""Exact substring deduplication with a suffix array built by deep-shallow sorting.

A byte goes if it lies in a `span`-byte string that also starts anywhere else in the corpus.  A suffix array
of every position of the corpus would be moved once per byte; here only suffixes that can repeat are sorted:

* every window of `span` bytes is keyed by the smallest hash among its `gram`-byte grams, so equal windows have
  equal keys; neighbouring windows share a key and form a run (a run and its bytes: a context);
* keys that occur once in the corpus cannot hide a repeat; equal contexts collapse to one with a count;
* contexts that share a key with a different one meet in one partition, and the suffixes at their windows'
  starts are sorted deep-shallow: multikey quicksort over eight-byte characters down to `shallow` bytes, then
  blind tries order the groups that still share a prefix.  Suffixes whose common prefix reaches `span` repeat.

Keys with more than `hot` different contexts (a passage in a third of all documents, each time in other
surroundings) are split further by the bytes that a few neighbouring windows have in common, which equal windows
share too; equal pieces collapse to one with a count, by partial sums before the shuffle.  Where more than `hot`
different pieces still share those bytes, each window stands for itself and is counted by a 128-bit digest.  So no task
holds more than `hot` pieces of one group.  Nothing is dropped: what does not meet cannot be equal.

Defined cases: a null text counts as empty; texts shorter than `span` lose nothing; equal rows are copies of
each other; texts of any length are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import HELD, row_key, sized, text_slices, written

SPAN = 200
GRAM = 64
SHALLOW = 160
HOT = 2_000
CHUNK = 16
#: Bytes whose suffixes are sorted at a time; a key's contexts are never parted.
SORTED = 4 << 20
_RNG = np.random.default_rng(11)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_MUL = _RNG.integers(1, 1 << 63, 6, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each position on, by doubling; one for each full gram."""
    h, width = _BYTE[data], 1
    with np.errstate(over="ignore"):
        for mul in _MUL:
            h = h[:-width] * mul + h[width:]
            width *= 2
        h ^= h >> np.uint64(31)
        h *= _ODD
        h ^= h >> np.uint64(29)
    return h


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every `width` neighbours."""
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def runs_of(texts: list[bytes], span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, key, context hash, repeats inside) of every run of windows that share a key."""
    none = np.empty(0, np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < span:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    width = span - GRAM + 1
    h = gram_hashes(data)
    low = _sliding(h, width, np.minimum)
    ends = np.cumsum(sizes)
    first = ends - sizes
    fits = np.zeros(len(low) + 1, np.int32)  # windows that stay inside one text
    long = sizes >= span
    np.add.at(fits, first[long], 1)
    np.add.at(fits, ends[long] - span + 1, -1)
    inside = np.cumsum(fits[:-1]) > 0
    cut = np.ones(len(low), bool)
    cut[1:] = (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])
    cut[first[long]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(low))
    keep = inside[start]
    start, end = start[keep], end[keep]
    # a run longer than one gram's reach holds the key twice; its parts are runs of their own
    parts = -(-(end - start) // width)
    at = np.repeat(np.arange(len(start)), parts)
    k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = start[at] + k * width
    n = np.minimum(end[at], begin + width) - begin
    # a gram that is the smallest of some window, again within reach: the window may repeat in its own run
    high = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), np.where(inside, low, np.uint64(0)), np.zeros(len(h) - len(low), np.uint64)]), width, np.maximum)[: len(h)]
    anchors = np.flatnonzero(high == h)
    again = (h[anchors[1:]] == h[anchors[:-1]]) & (np.diff(anchors) < width)
    twice = np.zeros(len(h) + 1, np.int64)
    both = anchors[1:][again]
    twice[np.maximum(0, both - width + 1)] = 1  # some window start that sees both
    twice[anchors[:-1][again]] = 1
    seen = np.cumsum(twice)
    repeats = (seen[np.minimum(begin + n - 1 + width, len(h))] - seen[begin] + twice[begin]) > 0
    size = n + span - 1
    context = n.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, 2 * span, GRAM):
            context = (context ^ h[begin + np.minimum(i, size - GRAM)]) * _ODD
            context ^= context >> np.uint64(32)
    text = np.searchsorted(ends, begin, side="right")
    return text, begin - first[text], n, low[begin], context, repeats.astype(np.int64)


class BlindTrie:
    """Orders strings of one length: branches keep only the place where their strings differ."""

    def __init__(self) -> None:
        self.root: list | None = None  # a leaf is [None, string, members]; a branch is [place, {byte: node}]

    def insert(self, text: bytes, member: int) -> None:
        if self.root is None:
            self.root = [None, text, [member]]
            return
        node = self.root
        while node[0] is not None:  # down to some leaf, without comparing
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        if node[1] == text:
            node[2].append(member)
            return
        differ = (int.from_bytes(node[1]) ^ int.from_bytes(text)).bit_length()
        place = len(text) - (differ + 7) // 8
        parent, node2 = None, self.root
        while node2[0] is not None and node2[0] < place:
            parent, node2 = node2, node2[1][text[node2[0]]]
        leaf = [None, text, [member]]
        if node2[0] == place:
            node2[1][text[place]] = leaf
            return
        branch = [place, {node[1][place]: node2, text[place]: leaf}]
        if parent is None:
            self.root = branch
        else:
            parent[1][text[parent[0]]] = branch

    def groups(self) -> Iterator[list[int]]:
        """Members of equal strings, in order of the strings."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                yield node[2]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]


def deep_shallow(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int = SPAN, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of (group, their first `depth` bytes), and for each whether it equals the one before.

    Rounds of multikey quicksort split all groups at once by the next eight bytes; places that are alone are done.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    order = np.argsort(group, kind="stable")
    cls = np.concatenate([[0], np.cumsum(group[order][1:] != group[order][:-1])]) if len(order) else order
    at = 0
    live = np.arange(len(order))  # places still in a group of two or more
    same = np.zeros(len(order), bool)
    same[1:] = cls[1:] == cls[:-1]
    while at < shallow and at < depth:
        grouped = same.copy()
        grouped[:-1] |= same[1:]
        live = live[grouped[live]]
        if not len(live):
            return order, same
        step = min(8, depth - at)
        character = np.ascontiguousarray(eight[starts[order[live]] + at]).view(">u8").ravel().astype(np.uint64)
        if step < 8:
            character >>= np.uint64(8 * (8 - step))
        sub = np.lexsort((character, cls[live]))
        order[live] = order[live[sub]]
        character = character[sub]
        new = np.zeros(len(live), bool)
        new[1:] = character[1:] != character[:-1]
        same[live] &= ~new
        cls = np.cumsum(~same)
        at += step
    if at < depth:
        grouped = same.copy()
        grouped[:-1] |= same[1:]
        bounds = np.flatnonzero(grouped & ~same)
        raw = data.tobytes()
        for b in bounds.tolist():
            e = b + 1
            while e < len(same) and same[e]:
                e += 1
            trie = BlindTrie()
            tails: dict[bytes, list[int]] = {}
            for i in order[b:e].tolist():
                tails.setdefault(raw[starts[i] + at : starts[i] + depth], []).append(i)
            if len(tails) == 1:
                continue
            for tail, members in tails.items():
                trie.insert(tail, members[0])
            place = b
            for (leaf,) in trie.groups():
                members = tails[raw[starts[leaf] + at : starts[leaf] + depth]]
                order[place : place + len(members)] = members
                same[place] = False if place > b else same[place]
                place += len(members)
    return order, same


def repeated(contexts: list[bytes], windows: np.ndarray, times: np.ndarray, group: np.ndarray, span: int = SPAN) -> list[np.ndarray]:
    """For each context the flags of its windows: whether the window also stands elsewhere."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(contexts)), windows)
    begin = np.cumsum(windows) - windows
    starts = first[owner] + np.arange(int(windows.sum())) - begin[owner]
    order, same = deep_shallow(data, starts, group[owner], span)
    twin = same.copy()
    twin[:-1] |= same[1:]
    flags = np.zeros(len(starts), bool)
    flags[order[twin]] = True
    flags |= times[owner] > 1
    return np.split(flags, begin[1:])


def _spans(flags: np.ndarray, shift: int) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a) + shift, "b": int(b) + shift} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _contexts(docs: DataFrame, wanted: DataFrame, n_bytes: int, span: int) -> DataFrame:
    """The bytes of the wanted contexts: (key, context, times) and the first window's offset, windows, core, data, a digest of it and hot."""
    # few numbers for each: lo and n in one, times below 0 where the key is hot
    each = F.struct((F.shiftleft(F.col("lo").cast("long"), 32) + F.col("n")).alias("at"), "key", "context", F.when(F.col("hot"), -F.col("times")).otherwise(F.col("times")).alias("times"))
    lists = wanted.groupBy("row_key").agg(F.collect_list(each).alias("wanted"))
    joined = docs.join(sized(lists, n_bytes), "row_key").dropDuplicates(["row_key"]) if n_bytes else docs.join(lists, "row_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "context", "times", "shift", "core", "windows", "data", "digest", "hot"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]
        for batch, texts in text_slices(batches, max_bytes=2 << 20):
            out: list[tuple] = []
            for text, rows in zip(texts, batch.column("wanted").to_pylist(), strict=True):
                for w in rows:
                    lo, n, times = w["at"] >> 32, w["at"] & 0xFFFFFFFF, abs(w["times"])
                    if w["times"] > 0:
                        out.append((w["key"], w["context"], times, 0, 0, n, text[lo : lo + n + span - 1], None, False))
                        continue
                    # windows by their distance to their first smallest gram, a few at a time, keyed by the bytes these have in common
                    h = gram_hashes(np.frombuffer(text[lo : lo + n + span - 1], np.uint8)).view(np.int64)
                    anchors = np.flatnonzero(h == w["key"])
                    off = anchors[np.searchsorted(anchors, np.arange(n))] - np.arange(n)
                    part = off // CHUNK
                    edges = np.concatenate([[0], np.flatnonzero((np.diff(part) != 0) | (np.diff(off) > 0)) + 1, [n]])
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        anchor = lo + a + int(off[a])
                        top, bottom = int(part[a]) * CHUNK + CHUNK - 1, int(part[a]) * CHUNK
                        core = text[anchor - bottom : anchor - top + span]
                        digest = hashlib.blake2b(core, digest_size=8, salt=bytes([int(part[a])])).digest()
                        data = text[lo + a : lo + b + span - 1]
                        out.append((w["key"], w["context"], times, a, int.from_bytes(digest, "little", signed=True), b - a, data, hashlib.blake2b(data, digest_size=16).digest(), True))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return joined.select("text", "wanted").mapInArrow(run, "key long, context long, times long, shift int, core long, windows int, data binary, digest binary, hot boolean")


def deduplicate(docs: DataFrame, span: int = SPAN, hot: int = HOT) -> DataFrame:
    """doc_id, text and `removed`: array of (start, end) byte ranges, in order, that repeat elsewhere."""
    if span < 2 * GRAM:
        raise ValueError(f"span must be at least {2 * GRAM}")
    docs = docs.select("doc_id", "text").withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, max_bytes=2 << 20):
            text, lo, n, key, context, again = runs_of(texts, span)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key").take(pa.array(text)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), pa.array(again.astype(bool))],
                names=["row_key", "lo", "n", "key", "context", "again"],
            )

    runs = written(docs.select("row_key", "text").mapInArrow(find, "row_key long, lo int, n int, key long, context long, again boolean"), "runs")
    # a key that stands in one run, once, cannot repeat
    keys = written(runs.groupBy("key").agg(F.count("*").alias("runs"), F.max("again").alias("again")).where("runs > 1 or again").select("key"), "repeated")
    # as many as the corpus has repeated places: never sent to every executor, at any size
    met = written(runs.join(keys.hint("merge"), "key", "left_semi"), "met")
    classes = met.groupBy("key", "context").agg(F.count("*").alias("times"), F.max("again").alias("again"), F.min(F.struct("row_key", "lo", "n")).alias("at"))
    classes = written(classes, "classes")
    width = classes.groupBy("key").agg(F.count("*").alias("different"))
    mixed = width.where("different > 1").withColumn("hot", F.col("different") > hot)
    # contexts without a different partner need no sorting: their count decides; a gram that comes again asks for a look inside
    plain = classes.join(mixed, "key", "left_anti")
    sure = plain.where("times > 1").select("key", "context", F.array(F.struct(F.lit(0).alias("a"), F.col("at.n").alias("b"))).alias("spans"))
    look = classes.join(mixed.select("key", "hot"), "key").unionByName(plain.where("times = 1 and again").withColumn("hot", F.lit(False)))
    wanted = written(look.select("key", "context", "times", "hot", "at.*"), "wanted")
    contexts = written(_contexts(docs, wanted, _bytes(wanted.groupBy("row_key").agg(F.count("*").alias("n")), 2, "n", 4), span), "contexts")
    # equal pieces of hot keys collapse before they move; a group that still has too many is told apart window by window
    piece = ["key", "core", "digest"]
    pieces = written(contexts.where("hot").groupBy(*piece).agg(F.sum("times").alias("times"), F.min("windows").alias("windows"), F.min("data").alias("data")), "pieces")
    full = written(pieces.groupBy("key", "core").count().where(F.col("count") > hot).select("key", "core"), "full")
    held_full = sized(full, _bytes(full, 2))
    window = pieces.join(held_full, ["key", "core"], "left_semi").select(*piece, "times", "data", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("i"))
    window = written(window.select(*piece, "times", "i", F.md5(F.substring("data", F.col("i") + 1, F.lit(span))).alias("window")), "single")
    again = written(window.groupBy("window").agg(F.sum("times").alias("times")).where("times > 1").select("window"), "again")
    single = window.join(sized(again, _bytes(again, 5)), "window", "left_semi").groupBy(*piece).agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("a"), (F.col("i") + 1).alias("b")))).alias("spans"))
    few = pieces.join(held_full, ["key", "core"], "left_anti").select("key", F.lit(None).cast("long").alias("context"), "times", F.lit(0).alias("shift"), "core", "windows", "data", "digest")
    sorted_apart = contexts.where("not hot").drop("hot").unionByName(few)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sort(rows: list) -> pa.RecordBatch:
            group = np.unique(np.array([(r[0], r[4]) for r in rows], np.int64), axis=0, return_inverse=True)[1].ravel()
            flags = repeated([r[6] for r in rows], np.array([r[5] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), group, span)
            spans = [_spans(f, r[3]) for f, r in zip(flags, rows, strict=True)]
            some = [i for i, s in enumerate(spans) if s]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            return pa.RecordBatch.from_arrays([*(pa.array([rows[i][c] for i in some], t) for c, t in ((0, pa.int64()), (1, pa.int64()), (4, pa.int64()), (7, pa.binary()))), pa.array([spans[i] for i in some], kind)], names=["key", "context", "core", "digest", "spans"])

        held: list = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SORTED and (row[0], row[4]) != last:
                    yield sort(held)
                    held, size = [], 0
                last = (row[0], row[4])
                held.append(row)
                size += len(row[6])
        if held:
            yield sort(held)

    together = sorted_apart.repartition("key", "core").sortWithinPartitions("key", "core")
    judged = written(together.mapInArrow(judge, "key long, context long, core long, digest binary, spans array<struct<a:int,b:int>>"), "judged")
    # pieces tell their contexts, each from its own offset
    told = written(judged.where("context is null").select(*piece, "spans").unionByName(single), "told")
    shifted = F.transform("spans", lambda s: F.struct((s["a"] + F.col("shift")).alias("a"), (s["b"] + F.col("shift")).alias("b")))
    back = contexts.where("hot").select(*piece, "context", "shift").join(sized(told, _bytes(told, 6, F.size("spans"))), piece).select("key", "context", shifted.alias("spans"))
    found = judged.where("context is not null").select("key", "context", "spans").unionByName(back).unionByName(sure)
    found = written(found, "found")
    each = met.select("row_key", "lo", "key", "context").join(found.hint("merge"), ["key", "context"])
    ranges = each.select("row_key", F.explode(F.transform("spans", lambda s: F.struct((F.col("lo") + s["a"]).alias("a"), (F.col("lo") + s["b"] + span - 1).alias("b")))).alias("r"))
    ranges = ranges.groupBy("row_key").agg(F.collect_list("r").alias("removed")).mapInArrow(_joined, "row_key long, removed array<struct<a:int,b:int>>")
    ranges = written(ranges, "ranges")
    return docs.join(sized(ranges, _bytes(ranges, 2, F.size("removed"))), "row_key", "left").drop("row_key")


def _bytes(df: DataFrame, words: int, structs: Column | str | None = None, fields: int = 2) -> int:
    """What df takes as a broadcast: rows of so many eight-byte words, and in an array so many structs of so many fields."""
    inner = F.lit(0) if structs is None else 16 + (16 + 8 * fields) * (F.col(structs) if isinstance(structs, str) else structs)
    return df.agg(F.sum(HELD + 8 * words + inner).cast("long")).first()[0] or 0


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of each row in order, those that touch as one: neighbouring contexts of a passage give one range, not many."""
    for batch in batches:
        column = batch.column("removed")
        sizes = pa.compute.list_value_length(column).to_numpy()
        row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) << 32
        flat = column.flatten()
        a, b = (row + flat.field(c).to_numpy().astype(np.int64) for c in ("a", "b"))
        order = np.argsort(a, kind="stable")
        a, far = a[order], np.maximum.accumulate(b[order])
        new = np.ones(len(a), bool)
        new[1:] = a[1:] > far[:-1]
        start, end = a[new], far[np.append(np.flatnonzero(new)[1:], len(a)) - 1]
        offsets = np.searchsorted(start, np.arange(len(sizes) + 1, dtype=np.int64) << 32).astype(np.int32)
        low = lambda x: pa.array((x & 0xFFFFFFFF).astype(np.int32))
        spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([low(start), low(end)], names=["a", "b"]))
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), spans], names=["row_key", "removed"])


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for r in ranges or []:
        if out and r["a"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r["b"]))
        else:
            out.append((r["a"], r["b"]))
    return out


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of deduplicate()'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            rows = []
            for text, ranges in zip(texts, batch.column("removed").to_pylist(), strict=True):
                gone = merged(ranges)
                sha, at = hashlib.sha256(), 0
                for a, b in gone:
                    sha.update(text[at:a])
                    at = b
                sha.update(text[at:])
                rows.append((len(text), sum(b - a for a, b in gone), len(gone), sha.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
