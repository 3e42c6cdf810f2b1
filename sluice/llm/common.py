"""Pieces the operators of this subpackage share: table access, shared storage, text batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.storage import dropped, scratch, shared_dir, written

__all__ = ["dropped", "scratch", "shared_dir", "written"]

#: The largest table, in bytes as measured, that is sent to every executor; beyond it a shuffle join takes over.
BROADCAST_BYTES = 48 << 20

#: What a row of a broadcast takes beside its values: its header, its key once more and its place in the hash table.
HELD = 64

#: Rows and bytes of an Arrow batch: texts are long, and a batch stands in memory on both sides of the pipe.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def row_key(*cols: Column) -> Column:
    """Rows that agree in all of cols share a key, so a left join on it never multiplies rows."""
    return F.xxhash64(*cols)


def sized(df: DataFrame, n_bytes: int) -> DataFrame:
    """Broadcast df only if its measured size is within the bound; otherwise Spark sorts and merges, which spills and splits skew."""
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df.hint("merge")


def first_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of df whose key has the smallest hash (ties by key); tasks send about 2n rows in all, not n each."""
    hashed = df.withColumn("_h", F.xxhash64(key))
    total = df.count()
    if total > 4 * n:
        few = hashed.where(F.col("_h") < int(-(2**63) + 2**64 * (2 * n + 100) / total))
        if few.count() >= n:
            hashed = few
    return hashed.orderBy("_h", key).limit(n).drop("_h")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 3 << 20
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut to about max_bytes of text each, with the texts as UTF-8 bytes (null: empty)."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary())
        sizes = np.fromiter((0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()), np.int64, len(texts))
        cuts = (np.cumsum(sizes) - sizes) // max_bytes
        at = 0
        while at < len(sizes):
            end = at + int(np.searchsorted(cuts[at:], cuts[at], side="right"))
            part = batch.slice(at, end - at)
            yield part, [x or b"" for x in texts.slice(at, end - at).to_pylist()]
            at = end


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task; one thing at a time, so operators do not add up.

    A worker outlives its stage: where another thing takes over, freed memory goes back to the system first.
    """
    if name not in _KEPT:
        _emptied()
        _KEPT[name] = make()
    return _KEPT[name]


def let_go() -> None:
    """Drop what an operator before this one kept in the worker; an operator that keeps nothing calls it as a task begins."""
    if _KEPT:
        _emptied()


def _emptied() -> None:
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """name, or the like of it that no column of df has."""
    while name in df.columns:
        name += "_"
    return name
