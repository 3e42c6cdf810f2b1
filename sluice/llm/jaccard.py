"""Exact n-gram Jaccard join by prefix trees, and the components of its links.

A document is the set of its n-word shingles, as 64-bit keys.  Keys are ordered globally: rare ones first, those
that a count over all documents shows to be frequent last, by key within.  Equal sets collapse to one node.
Sets that link share a key among their first size - needed + 1 keys, so nodes meet in an equi-join on those keys;
the places of the shared key and the sizes must leave room for the needed overlap.  Candidates of a node are
verified in a prefix tree: their ordered sets share the overlap already counted along a common path, and a
subtree is left as soon as the lengths that remain cannot reach the needed overlap.

Verification runs in two steps, neither of which drops a link between components.  First neighbours in the order of a
few minhashes of whole sets are verified; their links give provisional components, which melts groups of near copies
however large.  Then every two components that share a prefix key are verified: the nodes of the smaller one walk the
prefix trees of the larger one, whose nodes stand in blocks.  A set is sent once to a block, not once for each pair,
and one link of a node with a block is enough, since a block is part of one component.  Whole sets travel as compressed
texts, a third of the size of their keys, and become keys again where they are walked.

Defined cases: null or wordless texts have empty sets and link with nothing; a text of fewer than n words is one
shingle; rows sharing a doc_id are judged each by its own text; a row without a doc_id gets the component of the
documents that its text links with, null if there is none; texts of any length are read whole; ties do not arise, a
component being named by its smallest doc_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import BROADCAST_BYTES, kept, scratch, sized, text_slices, written
from sluice.operators.components import connected_components

SHINGLE = 4
PERCENT = 85
#: Counters of the frequency count; a key is frequent if its counter reaches FREQUENT and three times the mean.
COUNTERS = 1 << 22
FREQUENT = 64
LOCAL = 5
#: Bits of a set's sketch, kept as columns of 64.
SKETCH = 512
#: Minhashes whose order makes the first step's neighbours.
MINHASHES = 4
#: Sets in one tree, probes of one copy of a tree.
TREE, PROBES = 256, 2_048
#: Neighbours looked at and taken for a node in each order of the first step.
LOOK, TAKE = 6, 2
CACHE = 300_000
#: Links whose components one task settles; more go through rounds over all machines.
AT_ONCE = 1_000_000
#: Bytes of text that become keys at once.
SLICE = 3 << 20
#: Bits of the map of wanted documents, where they are too many to broadcast.
WANTED_BITS = 1 << 28
_C = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(17).integers(1, 1 << 63, MINHASHES, dtype=np.uint64) | np.uint64(1)
_S = [f"s{i}" for i in range(SKETCH // 64)]
_M = [f"m{i}" for i in range(MINHASHES)]


class Shingler:
    def __init__(self, n: int = SHINGLE):
        self.n, self.words = n, {}

    def keys(self, texts: list[bytes]) -> list[np.ndarray]:
        """The distinct keys of each text, sorted."""
        split = [t.lower().split() for t in texts]
        if len(self.words) > CACHE:
            self.words = {}
        words = self.words
        for w in set().union(*split).difference(words):
            words[w] = xxhash.xxh3_64_intdigest(w)
        sizes = [len(s) for s in split]
        flat = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.uint64, sum(sizes))
        rolled = flat.copy()
        with np.errstate(over="ignore"):
            for i in range(1, self.n):
                rolled[: len(flat) - i] = rolled[: len(flat) - i] * _C + flat[i:]
            rolled = _spread(rolled)
        out, at = [], 0
        for size, s in zip(sizes, split, strict=True):
            if size >= self.n:
                out.append(np.unique(rolled[at : at + size - self.n + 1]))
            else:
                out.append(np.array([xxhash.xxh3_64_intdigest(b"\n".join(s), 5)] if s else [], np.uint64))
            at += size
        return out


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _counter(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def frequent(docs: DataFrame, n: int = SHINGLE) -> np.ndarray:
    """A bit for every counter, set where its keys are frequent: COUNTERS / 8 bytes at any size of input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = kept(f"shingles of {n}", lambda: Shingler(n)), np.zeros(COUNTERS, np.int32)
        for _, texts in text_slices(batches):
            counts += np.bincount(_counter(np.concatenate([np.empty(0, np.uint64), *shingler.keys(texts)])), minlength=COUNTERS).astype(np.int32)
        at = np.flatnonzero(counts >= max(LOCAL, 4 * counts.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[at], counts.sum(dtype=np.int64)))], names=["at", "n"])

    counts = docs.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    counts = written(counts, "frequent")
    total = counts.where("at = -1").first()
    least = max(FREQUENT, 3 * (total["n"] if total else 0) // COUNTERS)
    bits = np.zeros(COUNTERS, bool)
    # at most COUNTERS rows, whatever the input
    bits[counts.where(F.col("at") >= 0).where(F.col("n") >= least).select("at").toPandas()["at"].to_numpy(np.int64)] = True
    return np.packbits(bits)


def _ordered(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Keys under the global order: the top bit tells frequent from rare."""
    c = _counter(keys)
    often = (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1
    return np.sort((keys >> np.uint64(1)) | (often.astype(np.uint64) << np.uint64(63)))


def sketch(keys: np.ndarray) -> np.ndarray:
    """A bitmap of the places that keys hash to: a place one set has and another lacks is a key they do not share."""
    bits = np.zeros(SKETCH, np.uint8)
    bits[((keys * _C) >> np.uint64(65 - SKETCH.bit_length())).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def minhashes(rows: list[np.ndarray]) -> np.ndarray:
    """MINHASHES x rows: the smallest hash of each set under each hash function (0 of an empty set)."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.zeros((MINHASHES, len(rows)), np.int64)
    some = sizes > 0
    if some.any():
        flat, at = np.concatenate(rows), (np.cumsum(sizes) - sizes)[some]
        with np.errstate(over="ignore"):
            for i, odd in enumerate(_ODD):
                out[i, some] = np.minimum.reduceat(flat * odd, at).view(np.int64)
    return out


def needed(na: np.ndarray | int, nb: np.ndarray | int, percent: int = PERCENT):  # noqa: ANN201
    """The least overlap of two linked sets."""
    return -((-percent * (na + nb)) // (100 + percent))


class PrefixTree:
    """Sets of keys in order of their sequences, with the lengths of common paths: a trie, read depth first.

    Sets may be given by their first keys alone, their sizes telling how many there are.
    """

    def __init__(self, members: list[np.ndarray], sizes: list[int]):
        raw = [m.astype(">u8").tobytes() for m in members]
        self.order = sorted(range(len(members)), key=raw.__getitem__)
        self.members, self.sizes = members, sizes

    def reach(self, probe: np.ndarray, size: int, percent: int = PERCENT, among: np.ndarray | None = None, first: bool = False) -> list[int]:
        """The members (of those that `among` flags) that can link with probe, by one walk; exact if the sets are whole.

        Counts of overlap along the current path are kept, so a shared path is counted once; with `first` the walk ends
        at the first member found.
        """
        seen_all = len(probe) == size
        out: list[int] = []
        path, counted = np.empty(0, np.uint64), np.zeros(1, np.int64)  # counted[i]: overlap of the path's first i keys
        for i in self.order:
            if among is not None and not among[i]:
                continue
            m = self.members[i]
            least = int(needed(size, self.sizes[i], percent))
            # past the end of what is known of the probe nothing can be told
            end = len(m) if seen_all else int(np.searchsorted(m, probe[-1], "right"))
            k = min(len(path), end, len(counted) - 1)
            differ = np.flatnonzero(path[:k] != m[:k])
            depth = int(differ[0]) if len(differ) else k
            counts = [counted[: depth + 1]]
            have = int(counted[depth])
            while True:
                met = int(np.searchsorted(probe, m[depth - 1], "right")) if depth else 0
                if have + min(size - met, self.sizes[i] - depth) < least:
                    break  # nothing below this place can reach the needed overlap
                if depth == end:
                    if not seen_all and end < len(m):
                        met = len(probe)
                    if have + min(size - met, self.sizes[i] - depth) >= least:
                        out.append(i)
                    break
                step = m[depth : min(end, depth + 64)]
                place = np.searchsorted(probe, step)
                hit = (place < len(probe)) & (probe[np.minimum(place, len(probe) - 1)] == step)
                more = have + np.cumsum(hit)
                counts.append(more)
                have, depth = int(more[-1]), depth + len(step)
            path, counted = m, np.concatenate(counts)
            if first and out:
                break
        return out


def _keys(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


def _unpacked(column: pa.Array, shingler: Shingler, bits: np.ndarray) -> list[np.ndarray]:
    """The ordered keys of packed texts, a few megabytes of text at a time."""
    unpack, out, texts, size = zstandard.ZstdDecompressor().decompress, [], [], 0
    for packed in column:
        texts.append(unpack(packed.as_py()))
        size += len(texts[-1])
        if size > SLICE:
            out += [_ordered(k, bits) for k in shingler.keys(texts)]
            texts, size = [], 0
    return out + ([_ordered(k, bits) for k in shingler.keys(texts)] if texts else [])


def walked(asked: DataFrame, members: DataFrame, sets: DataFrame, percent: int, held_bits: Broadcast, n: int, last: bool = False, first: bool = False) -> DataFrame:
    """Probes `asked` (a, label, part) against the members (label, part, b) of the same block.

    sets (id, size, and what is at hand of the sketch's columns and either keys or the packed text) are whole or known by
    their first keys.  The last walk gives (a, b), with `first` one b for a probe and block; any other gives (label, part, role, id): the probes (role 1) and
    members (role 0) with a partner that sizes, sketches and the walk leave room for.  A block with many probes is copied
    for every PROBES of them.
    """
    sketched, packed = [c for c in _S if c in sets.columns], "packed" in sets.columns
    keyed = packed or "keys" in sets.columns
    many = written(asked.groupBy("label", "part").count().where(F.col("count") > PROBES).select("label", "part", F.ceil(F.col("count") / PROBES).cast("int").alias("copies")), "many")
    copies = sized(many, 32 * many.count())
    asked = asked.join(copies, ["label", "part"], "left").select("a", "label", "part", F.coalesce(F.pmod(F.xxhash64("a"), F.col("copies")), F.lit(0)).cast("int").alias("copy"))
    members = members.join(copies, ["label", "part"], "left").select("b", "label", "part", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    rows = written(asked.select("label", "part", "copy", F.lit(1).alias("role"), F.col("a").alias("id")).unionByName(members.select("label", "part", "copy", F.lit(0).alias("role"), F.col("b").alias("id"))), "rows")
    block = ["label", "part", "copy"]
    # few rows go to the sets where they are, else both move; sets are the wide side
    together = sets.join(sized(rows, 48 * rows.count()), "id").select(*block, "role", "id", "size", *[c for c in ("keys", "packed") if c in sets.columns], *sketched).repartition(*block).sortWithinPartitions(*block, "role", "id")
    names, kinds = (["a", "b"], [pa.int64()] * 2) if last else (["label", "part", "role", "id"], [pa.int64(), pa.int32(), pa.int32(), pa.int64()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree, bits, sizes, met = (0, 0, 0), [], None, None, None, None
        found: list = []
        shingler = kept(f"shingles of {n}", lambda: Shingler(n)) if packed else None

        def done() -> None:
            if met is not None and not last:
                found.extend((at[0], at[1], 0, held[m][0]) for m in np.flatnonzero(met).tolist())

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*block, "role", "id", "size")]
            marks = np.stack([batch.column(c).to_numpy() for c in sketched], axis=1) if sketched else None
            if packed:
                keys = _unpacked(batch.column("packed"), shingler, held_bits.value)
            else:
                keys = _keys(batch.column("keys")) if keyed else [None] * batch.num_rows
            for r, (label, part, copy, role, i, size) in enumerate(zip(*columns, strict=True)):
                if (label, part, copy) != at:
                    done()
                    at, held, tree, met = (label, part, copy), [], None, None
                if role == 0:
                    held.append((i, size, keys[r].copy() if keyed else None, marks[r].copy() if sketched else None))
                    continue
                if not held:
                    continue
                if met is None:
                    met, sizes = np.zeros(len(held), bool), np.array([h[1] for h in held], np.int64)
                    tree = PrefixTree([h[2] for h in held], [h[1] for h in held]) if keyed else None
                    bits = np.stack([h[3] for h in held]) if sketched else None
                among = (sizes * percent <= size * 100) & (size * percent <= sizes * 100)
                if sketched:
                    among &= _roomy(marks[r], size, bits, sizes, percent)
                if not among.any():
                    continue
                good = tree.reach(keys[r], size, percent, among, first) if keyed else np.flatnonzero(among)
                met[good] = True
                if last:
                    found.extend((i, held[m][0]) for m in good)
                elif len(good):
                    found.append((label, part, 1, i))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=names)
            found.clear()
        done()
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=names)

    return together.mapInArrow(run, "a long, b long" if last else "label long, part int, role int, id long")


def _roomy(mark: np.ndarray, size: np.ndarray | int, marks: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches leave room for the needed overlap."""
    need = needed(size, sizes, percent)
    lacks = np.bitwise_count((mark & ~marks).view(np.uint64)).sum(axis=1, dtype=np.int64)
    others = np.bitwise_count((marks & ~mark).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return (size - lacks >= need) & (sizes - others >= need)


def key_table(docs: DataFrame, bits: np.ndarray, n: int, percent: int, whole: bool, wanted: np.ndarray | None = None) -> DataFrame:
    """doc_id, node (a digest of the set), n_shingles and, of the set, the keys of the prefix or as a `whole` its packed text.

    With the prefix come the columns of the sketch and the minhashes.  `wanted` is a bitmap over docs.at: rows whose bit is
    not set give no row.
    """
    held = docs.sparkSession.sparkContext.broadcast((bits, wanted))
    kind = "packed binary" if whole else "keys array<long>"
    extra = "" if whole else "".join(f", {c} long" for c in _S + _M)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, wanted = held.value
        shingler = kept(f"shingles of {n}", lambda: Shingler(n))
        if wanted is not None:
            batches = (b.filter(pa.array(_set(wanted, b.column("at").to_numpy()))) for b in batches)
        for batch, texts in text_slices(batches):
            rows = [_ordered(k, bits) for k in shingler.keys(texts)]
            nodes = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() if len(r) else None for r in rows]
            columns = [batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array([len(r) for r in rows], pa.int64())]
            if whole:
                pack = zstandard.ZstdCompressor().compress
                columns.append(pa.array([pack(t.lower()) for t in texts], pa.binary()))
            else:
                cut = [r[: len(r) + (-percent * len(r)) // 100 + 1] if len(r) else r for r in rows]
                offsets = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.uint64), *cut]).view(np.int64))))
                bitmaps = np.stack([sketch(r) for r in rows]) if rows else np.empty((0, len(_S)), np.int64)
                columns += [pa.array(c.copy()) for c in bitmaps.T] + [pa.array(c) for c in minhashes(rows)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n_shingles", kind.split()[0], *([] if whole else _S + _M)])

    return docs.select("doc_id", "text", *(["at"] if wanted is not None else [])).mapInArrow(run, f"doc_id long, node binary, n_shingles long, {kind}{extra}")


def _set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 6] >> (at & 63)) & 1 == 1


def bitmap(ids: DataFrame, bits: int = WANTED_BITS) -> np.ndarray:
    """The bits at hash_place(first) of all rows, as bits / 64 numbers: bounded at any number of rows."""
    at = ids.select(hash_place("first", bits).alias("at"))
    cells = at.groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("on")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[cells["cell"].to_numpy(np.int64)] = cells["on"].to_numpy(np.int64)
    return out


def hash_place(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits))


def neighbours(heads: DataFrame, percent: int) -> DataFrame:
    """(a, b): of the nodes before it in the order of a shared minhash and the next one, a few that can link with a node.

    Only minhashes that occur again are dealt, by ranges of that order: one that a third of all nodes share is split.
    """
    turns = [F.struct(F.lit(i).alias("i"), F.col(_M[i]).alias("m"), F.col(_M[(i + 1) % MINHASHES]).alias("next")) for i in range(MINHASHES)]
    each = heads.select("id", "size", *_S, F.explode(F.array(*turns)).alias("t")).select("t.*", "id", "size", *_S)
    again = written(each.groupBy("i", "m").count().where("count > 1").select("i", "m"), "again")
    each = each.join(sized(again, 24 * again.count()), ["i", "m"], "left_semi")
    order = ["i", "m", "next", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("i", "m", "id", "size", *_S)]
            old = len(last[0]) if last else 0
            if last:
                now = [np.append(x, y) for x, y in zip(last, now, strict=True)]
            i, m, ids, size = now[0], now[1], now[2], now[3].astype(np.int64)
            marks = np.stack(now[4:], axis=1)
            taken, pairs = np.zeros(len(ids), np.int64), []
            for lag in range(1, LOOK + 1):
                to = np.arange(max(lag, old), len(ids))
                to = to[(taken[to] < TAKE) & (i[to] == i[to - lag]) & (m[to] == m[to - lag]) & (ids[to] != ids[to - lag])]
                p, q = size[to], size[to - lag]
                need = needed(p, q, percent)
                x, y = marks[to], marks[to - lag]
                lacks = np.bitwise_count((x & ~y).view(np.uint64)).sum(axis=1, dtype=np.int64)
                others = np.bitwise_count((y & ~x).view(np.uint64)).sum(axis=1, dtype=np.int64)
                to = to[(np.maximum(p, q) * percent <= np.minimum(p, q) * 100) & (p - lacks >= need) & (q - others >= need)]
                taken[to] += 1
                pairs.append((ids[to], ids[to - lag]))
            a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            last = [x[-LOOK:] for x in now]

    return each.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id among documents reachable by links."""
    with scratch(docs.sparkSession):
        return written(_near_duplicates(docs, n, percent), "near", keep=True)


def _near_duplicates(docs: DataFrame, n: int, percent: int) -> DataFrame:
    bits = frequent(docs, n)
    table = written(key_table(docs, bits, n, percent, whole=False).withColumn("row", F.monotonically_increasing_id()), "keys")
    # a node is known by the row of its smallest document
    nodes = table.where("node is not null").groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "doc_id", "row")).alias("at"))
    nodes = written(nodes.select("node", F.col("at.row").alias("id"), F.col("at.doc_id").alias("first")), "nodes")
    heads = table.select(F.col("row").alias("id"), F.col("n_shingles").cast("int").alias("size"), "keys", *_S, *_M).join(sized(nodes.select("id"), 16 * nodes.count()), "id", "left_semi")

    # first step: neighbours by minhashes
    beside = written(neighbours(heads, percent), "beside")
    alone = lambda pairs: (pairs.select("a", F.col("a").alias("label"), F.lit(0).alias("part")).distinct(), pairs.select(F.col("a").alias("label"), F.lit(0).alias("part"), "b").distinct())
    links = _links(docs, nodes, heads, *alone(beside), bits, n, percent, False)
    known = written(connected_components(links, at_once=AT_ONCE), "melted")
    counts = known.groupBy("component").count().withColumnRenamed("count", "n")
    known = written(known.join(counts, "component").select(F.col("node").alias("id"), F.col("component").alias("label"), "n", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / TREE)).cast("int").alias("part")), "known")

    # second step: components that share a prefix key
    each = heads.select("id", "size", "keys").join(sized(known, 40 * known.count()), "id", "left")
    each = each.select("id", "size", F.coalesce("label", "id").alias("label"), F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("part", F.lit(0)).alias("part"), F.posexplode("keys").alias("place", "key"))
    mixed = written(each.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key"), "mixed")
    member = written(each.join(sized(mixed, 16 * mixed.count()), "key", "left_semi"), "member")
    asked = written(_asked(member, percent), "asked")
    blocks = written(asked.select("label", "part").distinct(), "blocks")
    others = member.select("label", "part", F.col("id").alias("b")).distinct().join(sized(blocks, 24 * blocks.count()), ["label", "part"], "left_semi")
    more = _links(docs, nodes, heads, asked, others, bits, n, percent, True)
    final = written(connected_components(links.unionByName(more), at_once=AT_ONCE).select(F.col("node").alias("id"), "component"), "components")

    named = nodes.join(sized(final, 24 * final.count()), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    return table.select("doc_id", "n_shingles", "node").join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _asked(member: DataFrame, percent: int) -> DataFrame:
    """(a, label, part): nodes and the blocks of larger components with which they share a key that leaves room."""
    block = member.groupBy("key", "label", "n", "part").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.min("place").alias("least")).alias("y")
    x = member.alias("x")
    need = F.ceil((F.col("x.size") + F.col("y.low")) * percent / (100.0 + percent) - 1e-9)
    fits = (
        (F.col("x.key") == F.col("y.key"))
        & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.label") < F.col("y.label"))))
        & (F.col("x.size") * percent <= F.col("y.high") * 100)
        & (F.col("y.low") * percent <= F.col("x.size") * 100)
        & (F.least(F.col("x.size") - F.col("x.place"), F.col("y.high") - F.col("y.least")) >= need)
    )
    return x.join(block, fits).select(F.col("x.id").alias("a"), F.col("y.label").alias("label"), F.col("y.part").alias("part")).distinct()


def _links(docs: DataFrame, nodes: DataFrame, heads: DataFrame, asked: DataFrame, members: DataFrame, bits: np.ndarray, n: int, percent: int, first: bool) -> DataFrame:
    """(a, b) that link: sketches, then a walk over the keys at hand leave few, whose whole sets are then made from a text each."""
    both = lambda rows: (rows.where("role = 1").select(F.col("id").alias("a"), "label", "part").distinct(), rows.where("role = 0").select("label", "part", F.col("id").alias("b")).distinct())
    held = docs.sparkSession.sparkContext.broadcast(bits)
    some = written(walked(asked, members, heads.select("id", "size", *_S), percent, held, n), "sketched")
    some = written(walked(*both(some), heads.select("id", "size", "keys", *_S), percent, held, n), "possible")
    wanted = written(nodes.select("node", "id", "first").join(some.select("id").distinct(), "id"), "wanted")
    size = 24 * wanted.count()
    texts = docs.select("doc_id", "text")
    if size <= BROADCAST_BYTES:
        found = key_table(texts.join(F.broadcast(wanted.select("first").distinct()), F.col("doc_id").eqNullSafe(F.col("first")), "left_semi"), bits, n, percent, whole=True)
    else:  # texts never shuffle: a bitmap of bounded size tells which are wanted, a few others pass and go in the next join
        found = key_table(texts.withColumn("at", hash_place("doc_id", WANTED_BITS)), bits, n, percent, whole=True, wanted=bitmap(wanted))
    got = found.join(sized(wanted.select("node", "id"), 2 * size), "node")
    # repeated rows give a set once more, and then a link: no harm
    sets = written(got.select("id", F.col("n_shingles").cast("int").alias("size"), "packed"), "sets")
    return written(walked(*both(some), sets, percent, held, n, last=True, first=first).distinct(), "links")
