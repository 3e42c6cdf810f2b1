"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.storage import dropped, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """(node, component): component is the smallest node reachable.  Nodes without an edge do not appear.

    Alternating large-star and small-star rounds: the number of rounds grows with the logarithm of the longest
    path, each node hands its neighbours to its smallest one, and no neighbourhood is ever collected.  Each round
    is written to shared storage, which cuts the lineage; the table of a round goes when the next one stands.
    Null ends and loops are ignored.  Up to `at_once` edges between numbers are settled by one task instead: a dozen queries
    less for the driver to plan and keep.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    pairs = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    if at_once and dict(pairs.dtypes) == {"u": "bigint", "v": "bigint"} and pairs.count() <= at_once:
        return pairs.coalesce(1).mapInArrow(_settled, "node long, component long")
    before = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x != y").unionByName(m.select(F.col("u").alias("x"), F.col("m").alias("y")))
        old = pairs
        pairs = written(small.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "cc")
        dropped(old)
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges (u, v): the larger root hangs below the smaller one until both ends of every edge agree."""
    got = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    u, v = (np.concatenate([x[k] for x in got]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    at, root = at.reshape(2, -1), np.arange(len(nodes))
    while (ends := root[at]).size and (ends[0] != ends[1]).any():
        np.minimum.at(root, ends.max(axis=0), ends.min(axis=0))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])
