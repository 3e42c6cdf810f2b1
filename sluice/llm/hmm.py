"""Language-model scoring with a hidden Markov model.

Tokens are the words of a text, ASCII lower-cased, and one end token.  Every token has a class: the most
frequent `own` training tokens are classes of their own, the others share classes by their last bytes.  A
hidden state emits a class, a class emits its token by smoothed training counts:

    P(text) = sum over state paths of prod P(state | last state) P(class | state)  x  prod P(token | class)

so scores are proper probabilities over an open vocabulary.  A bounded sample only makes the start of the model.  Then
Baum-Welch rounds run over all training texts: each partition runs forward-backward, expected counts are summed by
class across partitions, and only the sums (bounded by states x classes) reach the driver; rounds end when the
likelihood of all training tokens gains less than `least` a token, or after `rounds`.  Texts become class numbers once,
in a written table that all rounds read.

Forward-backward runs over overlapping segments, many at a time: a segment's counts are taken from its core alone, with
`MARGIN` tokens read before and after it, by which a chain has forgotten where it was cut.  Every token and every move
is counted once, starts at real starts of texts only.  Scoring runs the scaled forward recursion in double precision
over whole texts, so likelihoods are exact under the model.

The counts of rarer tokens are never broadcast: they meet the documents in a shuffle join.

Defined cases: a null or wordless text is the end token alone; no training text leaves uniform states
and counts of zero; texts of any length are scored whole; tokens of equal count rank in order of their text; repeated
rows get equal results and train each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import dropped, first_by_hash, text_slices, written

STATES = 8
OWN = 16_384
SUFFIXES = 2_048
KNOWN = 65_536
#: Tokens of a segment's core, and tokens read on both sides of it.
SEGMENT, MARGIN = 256, 16
#: Tokens that stand in memory at once in a round.
CODED = 1 << 19
#: Documents and rounds of the start; rounds over all texts, and the gain in nats a token that asks for another.
SAMPLE, START_ROUNDS = 1_500, 6
ROUNDS, LEAST = 3, 0.001
EPS = 0.05
#: The end token; no word is empty.
END = b""


def tokens(text: bytes) -> list[bytes]:
    out = text.lower().split()
    out.append(END)
    return out


def suffix_class(word: bytes) -> int:
    return crc32(word[-3:]) % SUFFIXES


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, n over all texts of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, max_bytes=12 << 20):
            got: Counter = Counter()
            for t in texts:
                got.update(t.lower().split())
            got[END] += len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()).cast(pa.string()), pa.array(list(got.values()), pa.int64())], names=["token", "n"])

    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """place: frequent tokens by rank; the first `own` are classes of their own.  logs: log10(count + 1) by rank."""

    place: dict[bytes, int]
    logs: np.ndarray
    own: int
    class_log: np.ndarray  # log10(tokens + distinct + 1) of each suffix class
    total: int
    distinct: int

    @property
    def classes(self) -> int:
        return self.own + SUFFIXES

    @property
    def code_bytes(self) -> int:
        return 2 if self.classes <= 1 << 16 else 4

    def codes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Classes and ranks (-1: none) of all tokens, tokens per text, and the tokens themselves."""
        split = [tokens(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = [w for s in split for w in s]
        get = self.place.get
        ranks = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        classes = ranks.copy()
        shared = np.flatnonzero((ranks < 0) | (ranks >= self.own))
        classes[shared] = self.own + np.fromiter((crc32(words[i][-3:]) for i in shared.tolist()), np.int64, len(shared)) % SUFFIXES
        return classes, ranks, sizes, words


def lexicon(counts: DataFrame, own: int = OWN, known: int = KNOWN) -> Lexicon:
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    # the tokens over a count that at most `known` reach; the histogram has a few hundred rows
    step = F.floor(F.log2("n") * 8).cast("int")
    least, held_by = 1 << 20, 0
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held_by += r["count"]
        if held_by > known:
            break
        least = r["step"]
    top = sorted(counts.where(step >= least).collect(), key=lambda r: (-r["n"], r["token"]))[:known]
    place = {r["token"].encode(): i for i, r in enumerate(top)}
    own = min(own, max(1, len(place)))
    if place.get(END, own) >= own:  # the end token is always a class of its own
        last = top[own - 1]["token"].encode() if top else END
        place[last], place[END] = place.get(END, 0), own - 1
    logs = np.zeros(max(1, len(place)))
    by = {r["token"].encode(): r["n"] for r in top}
    for w, i in place.items():
        logs[i] = np.log10(by.get(w, 0) + 1)
    held = counts.sparkSession.sparkContext.broadcast((place, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own = held.value
        n, v = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
        for b in batches:
            for w, c in zip(b.column("token").cast(pa.binary()).to_pylist(), b.column("n").to_pylist(), strict=True):
                if place.get(w, own) >= own:
                    k = suffix_class(w)
                    n[k] += c
                    v[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SUFFIXES)), pa.array(n), pa.array(v)], names=["k", "n", "v"])

    each = counts.mapInArrow(run, "k long, n double, v double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    class_log = np.zeros(SUFFIXES)
    for r in each:
        class_log[r["k"]] = np.log10(r["n"] + r["v"] + 1)
    return Lexicon(place, logs, own, class_log, int(sums[0] or 0), int(sums[1]))


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # classes x K

    @staticmethod
    def blank(classes: int, states: int = STATES) -> Model:
        rng = np.random.default_rng(3)
        emit = rng.dirichlet(np.full(states, 2.0), classes) + 1e-3
        move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
        return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def of(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        start, move, emit = start + EPS, move + EPS, emit + EPS
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def forward(model: Model, classes: np.ndarray, sizes: np.ndarray, keep: bool = False, begins: np.ndarray | None = None):  # noqa: ANN201
    """Natural log-likelihood of each sequence by the scaled recursion, in double precision.

    With keep: also all scaled alphas and scales, in single precision.  `begins` tells which sequences are starts of texts
    (all, if not given); the others start from the chain's long-run shares.
    """
    kind = np.float32 if keep else np.float64
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    lengths = sizes[order]
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
    out = np.zeros(len(sizes))
    alphas = np.empty((len(classes), len(model.start)), kind) if keep else None
    scales = np.empty(len(classes), kind) if keep else None
    move, emit = model.move.astype(kind), model.emit.astype(kind)
    a = np.broadcast_to(model.start.astype(kind), (len(sizes), len(model.start)))
    if begins is not None:
        a = np.where(begins[order][:, None], a, np.linalg.matrix_power(model.move, 256)[0].astype(kind))
    for t, n in enumerate(active.tolist()):
        at = starts[:n] + t
        a = (a[:n] @ move if t else a[:n]) * emit[classes[at]]
        s = a.sum(axis=1)
        a = a / s[:, None]
        out[:n] += np.log(s.astype(np.float64))
        if keep:
            alphas[at], scales[at] = a, s
    back = np.empty(len(sizes))
    back[order] = out
    return (back, alphas, scales, order, active) if keep else back


def expected(model: Model, classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of starts, moves and emissions of whole sequences, and their log-likelihood."""
    at, cut, begins, core = segments(sizes)
    classes = classes[at]
    _, alphas, scales, order, active = forward(model, classes, cut, keep=True, begins=begins)
    k = len(model.start)
    starts = (np.cumsum(cut) - cut)[order]
    move, emit = model.move.astype(np.float32), model.emit.astype(np.float32)
    moves = np.zeros((k, k))
    beta = np.ones((len(cut), k), np.float32)
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        m = int(active[t + 1]) if t + 1 < len(active) else 0
        at = starts[:n] + t
        if m:
            nxt = at[:m] + 1
            inner = emit[classes[nxt]] * beta[:m] / scales[nxt][:, None]
            moves += (alphas[at[:m]].T @ (inner * core[nxt][:, None])) * move
            beta[:m] = inner @ move.T
        g = alphas[at] * beta[:n]
        alphas[at] = g / g.sum(axis=1, keepdims=True)  # from here on the chance of each state
    held, shares = classes[core], alphas[core]
    emits = np.stack([np.bincount(held, shares[:, i], len(model.emit)) for i in range(k)], axis=1)
    first = (np.cumsum(cut) - cut)[begins]
    return alphas[first].sum(axis=0, dtype=np.float64), moves, emits, float(np.log(scales[core].astype(np.float64)).sum())


def segments(sizes: np.ndarray, longest: int = SEGMENT, margin: int = MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers of all overlapping segments one after the other, their sizes, which begin a text, and which tokens are core."""
    parts = -(-sizes // longest)
    owner = np.repeat(np.arange(len(sizes)), parts)
    low = (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)) * longest
    high = np.minimum(low + longest, sizes[owner])
    left, right = np.maximum(0, low - margin), np.minimum(sizes[owner], high + margin)
    cut = right - left
    within = np.arange(int(cut.sum())) - np.repeat(np.cumsum(cut) - cut, cut) + np.repeat(left, cut)
    core = (within >= np.repeat(low, cut)) & (within < np.repeat(high, cut))
    return within + np.repeat((np.cumsum(sizes) - sizes)[owner], cut), cut, low == 0, core


def coded(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """codes: the classes of each text's tokens, as unsigned numbers of lex.code_bytes bytes."""
    held = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held.value
        for _, texts in text_slices(batches):
            classes, _, sizes, _ = lex.codes(texts)
            offsets = np.concatenate([[0], np.cumsum(sizes)]) * lex.code_bytes
            values = classes.astype(f"<u{lex.code_bytes}")
            buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)]
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(sizes), buffers)], names=["codes"])

    return docs.select("text").mapInArrow(run, "codes binary")


def train(docs: DataFrame, lex: Lexicon, rounds: int = ROUNDS, states: int = STATES, sample: int = SAMPLE, least: float = LEAST) -> Model:
    first = first_by_hash(docs.where(F.col("doc_id").isNotNull()).select("doc_id"), "doc_id", sample).distinct()
    texts = [(r["text"] or "").encode() for r in docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").orderBy("doc_id", "text").limit(sample).collect()]
    model = Model.blank(lex.classes, states)
    classes, _, sizes, _ = lex.codes(texts)
    for _ in range(START_ROUNDS if texts else 0):
        model = Model.of(*expected(model, classes, sizes)[:3])
    before = -np.inf
    sc = docs.sparkSession.sparkContext
    codes, width = written(coded(docs, lex), "codes") if rounds else None, lex.code_bytes
    for _ in range(rounds):
        held = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            model = held.value
            k = len(model.start)
            start, move, emit, seen = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape), np.zeros(2)
            for _, texts in text_slices(batches, "codes", CODED * width):
                classes = np.frombuffer(b"".join(texts), f"<u{width}").astype(np.int32)
                sizes = np.fromiter(map(len, texts), np.int64, len(texts)) // width
                s, m, e, log = expected(model, classes, sizes)
                start, move, emit, seen = start + s, move + m, emit + e, seen + [log, len(classes)]
            at = np.flatnonzero(emit.sum(axis=1))
            names = np.concatenate([at, -1 - np.arange(k + 2)])  # -1: starts; then the rows of moves; last the likelihood and the tokens
            rows = np.concatenate([emit[at], start[None], move, np.resize(seen, k)[None]])
            yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(rows[:, i].copy()) for i in range(k))], names=["at", *(f"s{i}" for i in range(k))])

        names = [f"s{i}" for i in range(states)]
        schema = "at long, " + ", ".join(f"{n} double" for n in names)
        got = codes.mapInArrow(run, schema).groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((lex.classes, states))
        for at, row in zip(got["at"].tolist(), got[names].to_numpy(), strict=True):
            if at >= 0:
                emit[at] = row
            elif at == -1:
                start = row
            elif at > -states - 2:
                move[-at - 2] = row
            else:
                now = row[0] / max(1.0, row[1])
        model = Model.of(start, move, emit)
        held.unpersist()
        if not len(got) or now - before < least:
            break
        before = now
    if codes is not None:
        dropped(codes)
    return model


def score(docs: DataFrame, counts: DataFrame, lex: Lexicon, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10) of every row."""
    held = docs.sparkSession.sparkContext.broadcast((lex, model))
    schema = "doc_id long, n_tokens long, local_known long, local_log double, hmm double, rare array<struct<token:string,n:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = held.value
        for batch, texts in text_slices(batches):
            classes, ranks, sizes, words = lex.codes(texts)
            ends = np.cumsum(sizes)
            begins = ends - sizes
            logs = np.where(ranks >= 0, lex.logs[np.maximum(ranks, 0)], 0.0)
            shared = classes >= lex.own
            fixed = np.where(shared, (ranks >= 0) * logs - lex.class_log[np.maximum(classes - lex.own, 0)], 0.0)
            fixed, local = np.add.reduceat(fixed, begins), np.add.reduceat(logs, begins)
            lost = np.flatnonzero(ranks < 0)
            bounds = np.searchsorted(lost, np.append(begins, len(classes)))
            rare, lost = [], lost.tolist()
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                rare.append(Counter([words[x] for x in lost[i:j]]))
            known = np.add.reduceat((logs > 0).astype(np.int64), begins)
            del words, ranks, logs, shared, lost
            hmm = forward(model, classes, sizes) / np.log(10) + fixed
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rare])]).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array([w for r in rare for w in r], pa.binary()).cast(pa.string()), pa.array([n for r in rare for n in r.values()], pa.int32())], names=["token", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(known), pa.array(local), pa.array(hmm), pa.ListArray.from_arrays(pa.array(offsets), entries)],
                names=["doc_id", "n_tokens", "local_known", "local_log", "hmm", "rare"],
            )

    local = written(docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "local")
    rare = local.select("row", F.inline("rare")).withColumnRenamed("n", "times")
    met = rare.join(counts, "token").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_log"))
    log = F.coalesce("more_log", F.lit(0.0))
    return local.drop("rare").join(met, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("local_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("local_log") + log - F.col("n_tokens") * float(np.log10(lex.total + lex.distinct + 1))).alias("base_score"),
        (F.col("hmm") + log).alias("score"),
    )
