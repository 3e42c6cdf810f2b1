"""Quality classifier: hashed word n-gram logistic regression learned with follow-the-regularised-leader.

Features of a text are hashed into 2**bits slots: lower-cased words, pairs of neighbouring words, and the
same for the words' shapes (runs of letters, digits and each symbol; a word equal to the one before it has
a shape of its own).  A feature's value is its share of the text's features times a constant, so a score
is a sparse dot product over the whole text, whatever its length.

Training uses at most `sample` labelled documents (those with the smallest hash of doc_id), a documented
bound; scoring covers every row.  Defined cases: a null text counts as empty; an empty text gets the
intercept alone; without any labelled row every score is 0.5; repeated rows score alike; a doc_id
with several labels counts with the smallest; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import first_by_hash, let_go, text_slices

BITS = 18
SAMPLE = 4096
SCALE = 16.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-3
EPOCHS = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTERS, _DIGITS = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+")


def _shape(word: bytes) -> bytes:
    return _DIGITS.sub(b"0", _LETTERS.sub(b"a", word))[:8]


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all texts' features, one text after the other, and the number of features of each text."""
    split = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    words = np.empty(total, object)
    words[:] = [w for s in split for w in s]
    codes, known = pd.factorize(words)
    hashed = np.fromiter((crc32(w) for w in known), np.uint64, len(known))
    shaped = np.fromiter((crc32(_shape(w), 77) for w in known), np.uint64, len(known))
    first = np.zeros(total, bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    before = np.roll(codes, 1)
    before[first] = -1
    word, shape = hashed[codes], shaped[codes]
    shape[codes == before] = 12345
    old_word, old_shape = np.roll(word, 1), np.roll(shape, 1)
    old_word[first] = old_shape[first] = 0
    mixed = [word, word * _MIX + old_word * np.uint64(31) + np.uint64(1), shape + np.uint64(1 << 40), shape * _MIX + old_shape * np.uint64(37) + np.uint64(2)]
    slots = np.stack([((x * _MIX) >> np.uint64(64 - bits)).astype(np.int64) for x in mixed], axis=1)
    return slots.ravel(), sizes * len(mixed)


def train(texts: list[bytes], labels: list[int], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all slots and, last, the intercept."""
    n = (1 << bits) + 1
    z, sq = np.zeros(n), np.zeros(n)
    rows = []
    for text in texts:
        slots, _ = features([text], bits)
        at, count = np.unique(slots, return_counts=True)
        rows.append((np.append(at, n - 1).astype(np.int32), np.append(count * (SCALE / max(1, len(slots))), 1.0).astype(np.float32)))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        u = z[at]
        return np.where(np.abs(u) <= L1, 0.0, -(u - np.sign(u) * L1) / ((BETA + np.sqrt(sq[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - labels[i]) * x
            sigma = (np.sqrt(sq[at] + g * g) - np.sqrt(sq[at])) / ALPHA
            z[at] += g - sigma * w
            sq[at] += g * g
    return weights(slice(None)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, bits: int = BITS) -> np.ndarray:
    """Learn from the documents that `labels` marks; the sample is bounded, so it is broadcast and trained in one task."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    chosen = first_by_hash(marked, "doc_id", sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.lit(1).alias("one"), "doc_id", F.col("text"), "y")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        let_go()
        pdf = pdf.sort_values(["doc_id", "text"])
        texts = [(t or "").encode() for t in pdf["text"]]
        return pd.DataFrame({"weights": [train(texts, [int(y > 0) for y in pdf["y"]], bits).tobytes()]})

    got = rows.groupBy("one").applyInPandas(one, "weights binary").first()
    return np.frombuffer(got["weights"], np.float32) if got else np.zeros((1 << bits) + 1, np.float32)


def score_texts(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    bits = int(len(weights) - 1).bit_length() - 1
    slots, sizes = features(texts, bits)
    sums = np.zeros(len(texts))
    if len(slots):
        some = sizes > 0
        sums[some] = np.add.reduceat(weights[slots].astype(np.float64), (np.cumsum(sizes) - sizes)[some])
    return 1 / (1 + np.exp(-np.clip(weights[-1] + SCALE * sums / np.maximum(1, sizes), -30, 30)))


def score(docs: DataFrame, weights: np.ndarray, name: str = "quality_score") -> DataFrame:
    """docs with a double column `name` (in place of one of that name); the weights (2**bits floats) are broadcast."""
    docs = docs.drop(name)
    held = docs.sparkSession.sparkContext.broadcast(weights)
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(texts, held.value))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
