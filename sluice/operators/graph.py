"""Entity graph as tables: nodes, positions, match components, propagated labels, canonical names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sluice.functions.names import docket_label, is_docket, normalized
from sluice.operators.blocking import apart_in_documents
from sluice.operators.components import connected_components
from sluice.storage import written


def filer_nodes(filers: DataFrame, order: str = "line", known: DataFrame | None = None) -> DataFrame:
    """(norm, doc_id, raw_name): organisations by normalised name; the first raw name of a document stands for it.

    known (name, norm) has all names, where they are normalised already.
    """
    rows = normalized(filers.where(F.col("category") == "organization").select(F.col("document_id").alias("doc_id"), "name", order), known=known)
    return rows.groupBy("norm", "doc_id").agg(F.min_by("name", F.struct(order, "name")).alias("raw_name"))


def docket_nodes(dockets: DataFrame) -> DataFrame:
    """(docket, doc_id) of well-formed dockets; the others are in rejected_dockets()."""
    return dockets.select(docket_label(F.col("year"), F.col("number")).alias("docket"), F.col("document_id").alias("doc_id")).where(is_docket(F.col("docket"))).distinct()


def rejected_dockets(dockets: DataFrame) -> DataFrame:
    """Dockets that are malformed or have a position other than P or R."""
    return dockets.where(~is_docket(docket_label(F.col("year"), F.col("number"))) | ~F.coalesce(F.col("position").isin("P", "R"), F.lit(False)))


def positions(nodes: DataFrame, dockets: DataFrame, order: str = "line") -> DataFrame:
    """(norm, docket, position): the last one read of each name and docket that share a document."""
    d = dockets.where(F.col("position").isin("P", "R")).select(docket_label(F.col("year"), F.col("number")).alias("docket"), F.col("document_id").alias("doc_id"), "position", order)
    met = nodes.join(d.where(is_docket(F.col("docket"))), "doc_id")
    return met.groupBy("norm", "docket").agg(F.max_by("position", F.struct("doc_id", order, "position")).alias("position"))


def match_components(decisions: DataFrame, left: str = "left", right: str = "right", is_match: str = "is_match") -> DataFrame:
    """(node, component) over the match decisions; nodes of mismatches only are components of their own."""
    matches = decisions.where(F.col(is_match))
    ends = decisions.select(F.col(left).alias("node")).unionByName(decisions.select(F.col(right).alias("node"))).distinct()
    found = connected_components(matches, left, right)
    return ends.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _labelled(decisions: DataFrame, components: DataFrame, left: str, right: str, is_match: str) -> DataFrame:
    a = components.select(F.col("node").alias(left), F.col("component").alias("ca"))
    b = components.select(F.col("node").alias(right), F.col("component").alias("cb"))
    return decisions.where(~F.col(is_match)).join(a, left).join(b, right)


def conflicts(decisions: DataFrame, components: DataFrame, left: str = "left", right: str = "right", is_match: str = "is_match") -> DataFrame:
    """Mismatch decisions inside a match component: (component, left, right)."""
    return _labelled(decisions, components, left, right, is_match).where("ca = cb").select(F.col("ca").alias("component"), F.least(left, right).alias("left"), F.greatest(left, right).alias("right")).distinct()


def component_mismatches(decisions: DataFrame, components: DataFrame, left: str = "left", right: str = "right", is_match: str = "is_match") -> DataFrame:
    """(component_a, component_b), a < b: pairs of components some mismatch decision holds apart.

    The closure in short: two nodes match if they share a component, and mismatch if their components are such a
    pair.  It is as large as the decisions; closure() spells it out node by node.
    """
    return _labelled(decisions, components, left, right, is_match).where("ca != cb").select(F.least("ca", "cb").alias("component_a"), F.greatest("ca", "cb").alias("component_b")).distinct()


def closure(decisions: DataFrame, components: DataFrame, left: str = "left", right: str = "right", is_match: str = "is_match", most: int = 2_000, tasks: int = 96) -> DataFrame:
    """(u, v, is_match), u < v: every pair the decisions imply.

    The nodes of a component stand in parts of about `most`; two parts meet in a task, so a large component is many tasks.
    """
    counted = components.select("node", "component").join(components.groupBy("component").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")), "component")
    counted = counted.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    u = counted.select(F.col("component").alias("component_a"), F.col("part").alias("part_a"), F.col("node").alias("u"), "parts")
    v = counted.select(F.col("component").alias("component_b"), F.col("part").alias("part_b"), F.col("node").alias("v"), "parts")
    # what meets in a part is dealt out by number, since rows that are few make many
    here = u.withColumn("part_b", F.explode(F.expr("sequence(part_a, parts - 1)"))).repartition(tasks, "component_a", "part_a", "part_b").hint("shuffle_hash")
    there = v.withColumn("part_a", F.explode(F.expr("sequence(0, part_b)"))).withColumnRenamed("component_b", "component_a").repartition(tasks, "component_a", "part_a", "part_b")
    same = there.join(here, ["component_a", "part_a", "part_b"]).where("part_a < part_b or u < v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit(True).alias("is_match"))
    apart = component_mismatches(decisions, components, left, right, is_match)
    sizes = components.groupBy("component").agg(F.ceil(F.count("*") / most).cast("int").alias("n"))
    apart = apart.join(sizes.select(F.col("component").alias("component_a"), F.col("n").alias("na")), "component_a").join(sizes.select(F.col("component").alias("component_b"), F.col("n").alias("nb")), "component_b")
    apart = apart.withColumn("part_a", every("na")).withColumn("part_b", every("nb")).drop("na", "nb")
    other = apart.join(u.drop("parts"), ["component_a", "part_a"]).join(v.drop("parts"), ["component_b", "part_b"]).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit(False).alias("is_match"))
    return same.unionByName(other)


class Labels:
    """Decisions applied one after the other, as a reviewer makes them: each is taken with all it implies, or refused."""

    def __init__(self) -> None:
        self.parent: dict = {}
        self.members: dict = {}
        self.apart: dict[object, set] = {}

    def find(self, x):  # noqa: ANN001, ANN201
        self.parent.setdefault(x, x)
        self.members.setdefault(x, [x]) if self.parent[x] == x else None
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def label(self, left, right, is_match: bool) -> list[tuple] | None:  # noqa: ANN001
        """The new pairs (u, v, is_match) it implies, or None if it contradicts earlier decisions."""
        a, b = self.find(left), self.find(right)
        held = self.apart.setdefault(a, set())
        if is_match:
            if a == b:
                return []
            if b in held:
                return None
            new = [(u, v, True) for u in self.members[a] for v in self.members[b]]
            # what is apart from one side is now apart from the other side's members too
            for mine, theirs in ((a, b), (b, a)):
                for c in self.apart.setdefault(mine, set()) - self.apart.setdefault(theirs, set()):
                    new += [(u, v, False) for u in self.members[theirs] for v in self.members[c]]
            for c in self.apart[b]:
                self.apart[c].discard(b)
                self.apart[c].add(a)
            self.apart[a] |= self.apart.pop(b)
            self.parent[b] = a
            self.members[a] += self.members.pop(b)
            return new
        if a == b:
            return None
        if b in held:
            return []
        held.add(b)
        self.apart.setdefault(b, set()).add(a)
        return [(u, v, False) for u in self.members[a] for v in self.members[b]]


class LabelCounts:
    """Labels without the pairs: what a decision settles is counted from the sizes of components, in memory of nodes and mismatches.

    A component keeps the nodes it is apart from as a number, `light`, for those neighbours that are apart from up to `most` components;
    the others, which are few, are added when it is asked for.  So a component that grows tells at most `most` neighbours.
    """

    def __init__(self, most: int = 256) -> None:
        self.most, self.heavy = most, set()
        self.parent: dict = {}
        self.size: dict = {}
        self.apart: dict[object, set] = {}
        self.light: dict = {}

    def find(self, x):  # noqa: ANN001, ANN201
        parent = self.parent
        if x not in parent:
            parent[x], self.size[x], self.apart[x], self.light[x] = x, 1, set(), 0
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def _grown(self, a, n: int) -> None:  # noqa: ANN001
        """a, which no neighbour has counted for n nodes yet, tells them, or becomes one of the heavy ones."""
        if a in self.heavy:
            return
        if len(self.apart[a]) > self.most:
            self.heavy.add(a)
            n -= self.size[a]
        for c in self.apart[a] if n else ():
            self.light[c] += n

    def _apart_from(self, a) -> int:  # noqa: ANN001
        """The number of nodes that a is apart from."""
        held = self.apart[a]
        few = (h for h in self.heavy if h in held) if len(self.heavy) < len(held) else (h for h in held if h in self.heavy)
        return self.light[a] + sum(self.size[h] for h in few)

    def label(self, left, right, is_match: bool) -> int | None:  # noqa: ANN001
        """The number of new pairs it implies, or None if it contradicts earlier decisions."""
        a, b = self.find(left), self.find(right)
        if a == b:
            return 0 if is_match else None
        if b in self.apart[a]:
            return None if is_match else 0
        size, apart, light = self.size, self.apart, self.light
        if not is_match:
            apart[a].add(b)
            apart[b].add(a)
            for mine, theirs in ((a, b), (b, a)):
                if mine not in self.heavy:
                    light[theirs] += size[mine]
                    self._grown(mine, 0)
            return size[a] * size[b]
        if len(apart[a]) < len(apart[b]):
            a, b = b, a
        both = [c for c in apart[b] if c in apart[a]]
        shared = sum(size[c] for c in both)
        new = size[a] * size[b] + size[b] * (self._apart_from(a) - shared) + size[a] * (self._apart_from(b) - shared)
        for c in apart[b]:
            apart[c].discard(b)
            if b not in self.heavy:
                light[c] -= size[b]
            if c not in apart[a]:
                apart[c].add(a)
                apart[a].add(c)
                # as if a had always been there
                if c not in self.heavy:
                    light[a] += size[c]
                if a not in self.heavy:
                    light[c] += size[a]
        more = size[b]
        self.heavy.discard(b)
        self.parent[b] = a
        del apart[b], light[b], size[b]
        size[a] += more
        self._grown(a, more)
        return new


def apply_in_order(decisions: DataFrame, project: str, order: str, left: str = "left", right: str = "right", is_match: str = "is_match") -> DataFrame:
    """decisions with `accepted` and `implied` (number of pairs a decision settles), applied in order within each project.

    A project is what one team reviews and is one task; decisions across projects do not touch.  The task reads its decisions
    in order, some at a time, and keeps what LabelCounts keeps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, labels = None, LabelCounts()
        for batch in batches:
            got = []
            for p, a, b, m in zip(*(batch.column(c).to_pylist() for c in (project, left, right, is_match)), strict=True):
                if p != now:
                    now, labels = p, LabelCounts()
                got.append(labels.label(a, b, bool(m)))
            accepted, implied = pa.array([g is not None for g in got], pa.bool_()), pa.array([g or 0 for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, accepted, implied], names=[*batch.schema.names, "accepted", "implied"])

    told = decisions.repartition(project).sortWithinPartitions(project, order)
    return told.mapInArrow(run, decisions.withColumns({"accepted": F.lit(True), "implied": F.lit(0).cast("long")}).schema)


def medoids(named: DataFrame, most: int = 1_000) -> DataFrame:
    """(component, medoid): of (component, name) rows the name with the least mean edit distance to all names of its component.

    Repeated names count as often as they stand; ties go to the smaller name.  Names are compared once per different
    pair, weighted by their counts.  The names of a component stand in parts of about `most`; each name meets every part
    in a join of its own and the sums are added, so a large component is many tasks.
    """
    counts = named.groupBy("component", "name").agg(F.count("*").alias("times"))
    parts = counts.groupBy("component").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    counts = counts.join(parts, "component")
    other = counts.select("component", F.pmod(F.xxhash64("name"), "parts").cast("int").alias("part"), F.col("name").alias("other"), F.col("times").alias("weight"))
    mine = counts.select("component", "name", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    far = mine.join(other, ["component", "part"]).groupBy("component", "name").agg(F.sum(F.col("weight") * F.levenshtein("name", "other")).alias("far"))
    return far.groupBy("component").agg(F.min_by("name", F.struct("far", "name")).alias("medoid"))


def name_mapping(components: DataFrame, nodes: DataFrame) -> DataFrame:
    """(original_name, mapped_name): each node of a component of two or more to its medoid raw name.

    components: (node, component); nodes: (norm, doc_id, raw_name), node being a norm.
    """
    size = F.count("*").over(Window.partitionBy("component"))
    matched = components.withColumn("n", size).where("n > 1").select("node", "component")
    named = matched.join(nodes.select(F.col("norm").alias("node"), F.col("raw_name").alias("name")), "node")
    return matched.join(medoids(named.select("component", "name")), "component").select(F.col("node").alias("original_name"), F.col("medoid").alias("mapped_name"))


def _reduced(both: DataFrame, cover: int) -> tuple[DataFrame, DataFrame | None, Broadcast | None]:
    """The inverses of symmetric matrices over large components, by way of a few of their nodes.

    both: (component, u, v, c, d), an edge in both orders, the matrix having d at (u, u) and -c at (u, v).  Nodes that no edge joins and
    that come before all their neighbours in order of degree are eliminated at once; what is left is a matrix over the others, the
    cover, and is inverted whole: T.  With w of a node being its row c / d over the cover, or itself if it is one of the cover, the
    inverse at (a, b) is w_a T w_b, and 1 / d more at (a, a) of an eliminated node.

    Returns the edges of components whose covers are too large (the smallest covers go first while their squares add up to
    cover ** 2), the nodes of the others (component, node, d, own, w), and T by component, as a broadcast value.
    """
    spark = both.sparkSession
    k = both.groupBy("u").agg(F.count("*").alias("k"))
    near = both.join(k.select(F.col("u").alias("v"), "k"), "v").groupBy("component", "u").agg(F.count("*").alias("mine"), F.min(F.struct("k", "v")).alias("next"), F.max("d").alias("d"))
    nodes = written(near.select("component", F.col("u").alias("node"), "d", (F.col("next") < F.struct(F.col("mine").alias("k"), F.col("u").alias("v"))).alias("own")), "nodes")
    chosen, held = {}, 0
    for r in nodes.where("own").groupBy("component").agg(F.count("*").alias("n")).orderBy("n", "component").toLocalIterator():
        held += r["n"] ** 2
        if held > cover**2:
            break
        chosen[r["component"]] = r["n"]
    if not chosen:
        return both, None, None
    met = F.col("component").isin(list(chosen))
    rest, both, nodes = both.where(~met), both.where(met), nodes.where(met)
    index = nodes.where("own").withColumn("i", (F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1).cast("int"))
    into = both.join(index.select(F.col("node").alias("v"), F.col("i").alias("j")), "v")
    # a node that is eliminated has no more neighbours than the cover has nodes
    w = into.join(nodes.where("not own").select(F.col("node").alias("u")), "u", "left_semi").groupBy("component", "u", "d").agg(F.collect_list(F.struct(F.col("j").alias("i"), (F.col("c") / F.col("d")).alias("x"))).alias("w"))
    own = index.select("component", "node", "d", F.lit(True).alias("own"), F.array(F.struct("i", F.lit(1.0).alias("x"))).alias("w"))
    rows = written(w.select("component", F.col("u").alias("node"), "d", F.lit(False).alias("own"), "w").unionByName(own), "rows")

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for of, d, w in zip(batch.column("component").to_pylist(), batch.column("d").to_numpy(), batch.column("w"), strict=True):
                i, x = _sparse(w.values)
                if of not in sums:
                    sums[of] = np.zeros((chosen[of], chosen[of]))
                sums[of][i[:, None], i] += d * np.outer(x, x)
        for of, m in sums.items():
            i, j = np.nonzero(m)
            yield pa.RecordBatch.from_arrays([pa.array([of] * len(i), kind), pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array(m[i, j])], names=["component", "i", "j", "x"])

    kind = to_arrow_type(both.schema["component"].dataType)
    met_twice = into.join(index.select(F.col("node").alias("u"), "i"), "u").select("component", "i", "j", F.col("c").alias("x"))
    sums = rows.where("not own").select("component", "d", "w").mapInArrow(gram, f"component {dict(both.dtypes)['component']}, i int, j int, x double")
    taken = sums.unionByName(met_twice).groupBy("component", "i", "j").agg(F.sum("x").alias("x"))
    diagonal = index.select("component", "i", F.col("i").alias("j"), (-F.col("d")).alias("x"))
    left = {of: np.zeros((n, n)) for of, n in chosen.items()}
    for batch in taken.unionByName(diagonal).toArrow().to_batches():
        of, i, j, x = batch.column("component").to_pylist(), *(batch.column(c).to_numpy() for c in ("i", "j", "x"))
        of = np.array(of, dtype=object)
        for name in set(of.tolist()):
            here = of == name
            np.subtract.at(left[name], (i[here], j[here]), x[here])
    inverse = {of: np.linalg.inv(m) for of, m in left.items()}
    if any(not np.abs(m @ inverse[of] - np.eye(len(m))).max() < 1e-6 for of, m in left.items()):
        raise ArithmeticError("the matrix of a component is singular or too close to it")
    return rest, rows, spark.sparkContext.broadcast(inverse)


def _sparse(w: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    return w.field("i").to_numpy(), w.field("x").to_numpy()


def _dense(w: pa.ListArray, n: int) -> np.ndarray:
    out = np.zeros((len(w), n))
    (i, x), at = _sparse(w.flatten()), np.repeat(np.arange(len(w)), w.value_lengths().to_numpy())
    out[at, i] = x
    return out


def _all_inverse(rows: DataFrame, inverse: Broadcast, value: str, most: int = 1_000) -> DataFrame:
    """(u, v, value), both orders: the whole inverses that _reduced() gives in short, in tasks of two parts of about `most` nodes each."""
    kind, parts = dict(rows.dtypes)["node"], rows.groupBy("component").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    part = rows.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    other = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = other.select("component", "node", "d", "own", "w", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        t = inverse.value[table.column("component")[0].as_py()]
        here = table.column("part").to_numpy()
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        a, b = (table.take(np.flatnonzero(here == x)).combine_chunks() for x in (low, high))
        x, y = (_dense(s.column("w").combine_chunks() if isinstance(s.column("w"), pa.ChunkedArray) else s.column("w"), len(t)) for s in (a, b))
        q = (x @ t) @ y.T
        if low == high:
            out = np.flatnonzero(~a.column("own").to_numpy())
            q[out, out] += 1 / a.column("d").to_numpy()[out]
        u, v = a.column("node").take(np.repeat(np.arange(len(a)), len(b))), b.column("node").take(np.tile(np.arange(len(b)), len(a)))
        one = pa.table({"u": u, "v": v, value: q.ravel()})
        return one if low == high else pa.concat_tables([one, pa.table({"u": v, "v": u, value: q.ravel()})])

    return both.groupBy("component", "low", "high").applyInArrow(meet, f"u {kind}, v {kind}, {value} double")


def _pair_inverse(pairs: DataFrame, rows: DataFrame, inverse: Broadcast, value: str) -> DataFrame:
    """(u, v, value) of pairs (u, v) only, from what _reduced() gives."""
    kind = dict(rows.dtypes)["node"]
    # the matrix is symmetric; the side with the shorter row joins first and travels
    own = rows.where("own").select(F.col("node").alias("u"), F.lit(True).alias("turned"))
    turned = pairs.join(own, "u", "left").withColumn("turned", F.coalesce("turned", F.lit(False)))
    turned = turned.select(F.when(F.col("turned"), F.col("v")).otherwise(F.col("u")).alias("a"), F.when(F.col("turned"), F.col("u")).otherwise(F.col("v")).alias("b"), "turned")
    met = turned.join(rows.select(F.col("node").alias("b"), F.col("component").alias("of"), F.col("w").alias("y")), "b")
    met = met.join(rows.select(F.col("node").alias("a"), "component", "d", "own", F.col("w").alias("x")), "a").where("component = of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last, g = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, components, xs = batch.column("a").to_pylist(), batch.column("component").to_pylist(), batch.column("x")
            ys = batch.column("y")
            (i, y), ends = _sparse(ys.flatten()), np.concatenate([[0], np.cumsum(ys.value_lengths().to_numpy())])
            q = np.empty(len(names))
            for r, (name, component) in enumerate(zip(names, components, strict=True)):
                if name != last or component != of:
                    j, x = _sparse(xs[r].values)
                    of, last, g = component, name, x @ inverse.value[component][j]
                s = slice(ends[r], ends[r + 1])
                q[r] = g[i[s]] @ y[s]
            same = np.array(names, dtype=object) == np.array(batch.column("b").to_pylist(), dtype=object)
            q += np.where(same & ~batch.column("own").to_numpy(zero_copy_only=False), 1 / batch.column("d").to_numpy(), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("turned"), pa.array(q)], names=["a", "b", "turned", value])

    got = met.select("a", "b", "turned", "component", "d", "own", "x", "y").mapInArrow(run, f"a {kind}, b {kind}, turned boolean, {value} double")
    return got.select(F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")).alias("u"), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b")).alias("v"), value)


def regular_equivalence(edges: DataFrame, alpha: float = 0.85, largest: int = 2_000, tolerance: float = 1e-9, cover: int = 1_500, pairs: DataFrame | None = None) -> DataFrame:
    """(u, v, sigma) of (D - alpha A)^-1 over an undirected graph (u, v): how alike two nodes' neighbourhoods are, both orders.

    The matrix is block-diagonal by connected component, so each component of up to `largest` nodes is inverted in a task of
    its own.  Larger ones are reduced to the nodes that cover their edges, see _reduced().  Where those are more than `cover`, the
    series sum_k alpha^k (D^-1 A)^k D^-1 is followed from each node for as long as terms exceed `tolerance`, as joins with the
    edge table.  pairs (u, v) asks for those only, and no table of all pairs is made but by the series.
    """
    e = edges.select("u", "v").where("u != v").distinct()
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    component = connected_components(e, "u", "v")
    counted = component.withColumn("n", F.count("*").over(Window.partitionBy("component")))
    tagged = written(both.join(counted.select(F.col("node").alias("u"), "component", "n"), "u"), "tagged")
    asked = pairs.select("u", "v").where("u is not null and v is not null").distinct() if pairs is not None else None
    kind = dict(e.dtypes)["u"]

    def inverted(u: pd.Series, v: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        names = np.unique(u)
        i, j = np.searchsorted(names, u), np.searchsorted(names, v)
        a = np.zeros((len(names), len(names)))
        a[i, j] = 1.0
        return names, np.linalg.inv(np.diag(a.sum(axis=1)) - alpha * a)

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        names, sigma = inverted(pdf["u"], pdf["v"])
        return pd.DataFrame({"u": np.repeat(names, len(names)), "v": np.tile(names, len(names)), "sigma": sigma.ravel()})

    def answer(pdf: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or ask.empty:
            return pd.DataFrame({"u": [], "v": [], "sigma": []})
        names, sigma = inverted(pdf["u"], pdf["v"])
        ask = ask[ask["v"].isin(names)]
        return pd.DataFrame({"u": ask["u"], "v": ask["v"], "sigma": sigma[np.searchsorted(names, ask["u"]), np.searchsorted(names, ask["v"])]})

    few = tagged.where(F.col("n") <= largest)
    if asked is None:
        small = few.groupBy("component").applyInPandas(invert, f"u {kind}, v {kind}, sigma double")
    else:
        where = counted.where(F.col("n") <= largest).select(F.col("node").alias("u"), F.col("component").alias("of"))
        small = few.select("component", F.col("u").alias("u"), F.col("v").alias("v")).groupBy("component").cogroup(asked.join(where, "u").groupBy("of")).applyInPandas(answer, f"u {kind}, v {kind}, sigma double")
    large = tagged.where(F.col("n") > largest)
    if large.isEmpty():
        return small
    degree = large.groupBy("u").agg(F.count("*").cast("double").alias("d"))
    large, rows, inverse = _reduced(written(large.join(degree, "u").select("component", "u", "v", F.lit(alpha).alias("c"), "d"), "large"), cover)
    if rows is not None:
        small = small.unionByName(_all_inverse(rows, inverse, "sigma") if asked is None else _pair_inverse(asked, rows, inverse, "sigma"))
        if large.isEmpty():
            return small
    large = large.select("u", "v")
    degree = large.groupBy("u").agg(F.count("*").alias("d"))
    step = large.join(degree, "u").select(F.col("u").alias("m"), F.col("v").alias("next"), (F.lit(alpha) / F.col("d")).alias("share"))
    term = degree.select("u", F.col("u").alias("m"), F.lit(1.0).alias("x"))
    total = term
    for k in range(200):
        term = term.join(step, "m").groupBy("u", F.col("next").alias("m")).agg(F.sum(F.col("x") * F.col("share")).alias("x")).where(F.col("x") > tolerance)
        if k % 4 == 3:
            term = written(term, "term")
            total = written(total, "total")
            if term.isEmpty():
                break
        total = total.unionByName(term).groupBy("u", "m").agg(F.sum("x").alias("x"))
    ended = total.join(degree.select(F.col("u").alias("m"), "d"), "m").select("u", F.col("m").alias("v"), (F.col("x") / F.col("d")).alias("sigma"))
    return small.unionByName(ended if asked is None else ended.join(asked, ["u", "v"], "left_semi"))


def with_equivalence(pairs: DataFrame, sigma: DataFrame, left: str = "left_norm", right: str = "right_norm", name: str = "dc_reg_eq") -> DataFrame:
    """pairs with their sigma (u, v, sigma) as `name`: 1 for a name beside itself, 0 where there is none."""
    known = sigma.select(F.col("u").alias(left), F.col("v").alias(right), F.col("sigma").alias("_sigma"))
    value = F.when(F.col(left) == F.col(right), 1.0).otherwise(F.coalesce("_sigma", F.lit(0.0)))
    return pairs.join(known, [left, right], "left").withColumn(name, value).drop("_sigma")


def neighbouring_dockets(position_rows: DataFrame, names: DataFrame) -> DataFrame:
    """(docket): those on which one of names (norm) stands."""
    return position_rows.join(names.select("norm"), "norm", "left_semi").select("docket").distinct()


def probable_edges(pairs: DataFrame, nodes: DataFrame, p: str, left: str = "left_norm", right: str = "right_norm", known: DataFrame | None = None) -> DataFrame:
    """(left_norm, right_norm, p): the likeliest p of each pair; pairs of one name, of unknown names and of names that share a document go.

    The known names are those of known (norm), or else of nodes.
    """
    one = pairs.groupBy(F.least(left, right).alias("left_norm"), F.greatest(left, right).alias("right_norm")).agg(F.max(p).alias("p")).where("left_norm != right_norm")
    known = (nodes if known is None else known).select("norm").distinct()
    for side in ("left_norm", "right_norm"):
        one = one.join(known.withColumnRenamed("norm", side), side, "left_semi")
    return apart_in_documents(one, nodes)


def names_by_document(nodes: DataFrame) -> DataFrame:
    """(doc_id, names): the nodes of each document, in order; a document has few."""
    return nodes.groupBy("doc_id").agg(F.array_sort(F.collect_set("norm")).alias("names"))


def name_variants(nodes: DataFrame) -> DataFrame:
    """(norm, variants): the different raw names of each node, in order."""
    return nodes.groupBy("norm").agg(F.array_sort(F.collect_set("raw_name")).alias("variants"))


def _solved(i: np.ndarray, j: np.ndarray, p: np.ndarray, n: int, columns: np.ndarray, alpha: float, tolerance: float) -> np.ndarray:
    """Columns of (I - alpha P)^-1, P being symmetric with entries p at (i, j) and (j, i).

    Conjugate gradients on the least squares problem, which need no contraction, repeated on what is left over until no
    residual exceeds `tolerance`.
    """
    rows, across, weight = np.concatenate([i, j]), np.concatenate([j, i]), alpha * np.concatenate([p, p])
    order = np.argsort(rows, kind="stable")
    across, weight = across[order], weight[order, None]
    starts = np.searchsorted(rows[order], np.arange(n))
    step = max(1, 2_000_000 // len(across))

    def times(x: np.ndarray) -> np.ndarray:
        return x - np.hstack([np.add.reduceat(weight * x[across, c : c + step], starts, axis=0) for c in range(0, x.shape[1], step)])

    unit = np.zeros((n, len(columns)))
    unit[columns, np.arange(len(columns))] = 1.0
    x = np.zeros_like(unit)
    for _ in range(20):
        r = unit - times(x)
        before = np.abs(r).max()
        if before <= tolerance:
            return x
        s = times(r)
        way, gamma = s, (s * s).sum(axis=0)
        for _ in range(2 * n + 50):
            q = times(way)
            norm = (q * q).sum(axis=0)
            a = np.divide(gamma, norm, out=np.zeros_like(norm), where=norm > 0)
            x, r = x + a * way, r - a * q
            if np.abs(r).max() <= max(tolerance / 2, 1e-8 * before):
                break
            s = times(r)
            last, gamma = gamma, (s * s).sum(axis=0)
            way = s + np.divide(gamma, last, out=np.zeros_like(last), where=last > 0) * way
    raise ArithmeticError("I - alpha P of a component is singular or too close to it")


def pair_means(pairs: DataFrame, p: str, left: str = "left_norm", right: str = "right_norm") -> DataFrame:
    """(u, v, p): the mean of p for each pair in either order, both orders given; a name beside itself once, what is missing being 0."""
    one = pairs.groupBy(F.least(left, right).alias("u"), F.greatest(left, right).alias("v")).agg(F.avg(p).alias("p"))
    return one.unionByName(one.where("u != v").select(F.col("v").alias("u"), F.col("u").alias("v"), "p"))


def resolvent(pairs: DataFrame, p: str, alpha: float = 0.9, left: str = "left_norm", right: str = "right_norm", largest: int = 2_000, tolerance: float = 1e-11, cover: int = 1_500) -> DataFrame:
    """(u, v, q) of (I - alpha P)^-1 for the symmetric table of pair means, for each connected component.

    A component of up to `largest` nodes is inverted in a task of its own.  Larger ones are reduced to the nodes that cover their
    edges, see _reduced().  Where those are more than `cover`, tasks solve for some columns each, from the component's pairs alone,
    to a residual of `tolerance`.  All of this holds whether or not alpha P is a contraction.  A matrix that has no inverse is an
    error.
    """
    one = pair_means(pairs, p, left, right).where("u < v and p != 0")
    component = connected_components(one, "u", "v")
    counted = component.withColumn("n", F.count("*").over(Window.partitionBy("component")))
    tagged = written(one.join(counted.select(F.col("node").alias("u"), "component", "n"), "u"), "tagged")

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(pd.concat([pdf["u"], pdf["v"]]))
        i, j = np.searchsorted(names, pdf["u"]), np.searchsorted(names, pdf["v"])
        m = np.zeros((len(names), len(names)))
        m[i, j] = m[j, i] = pdf["p"]
        q = np.linalg.inv(np.eye(len(names)) - alpha * m)
        return pd.DataFrame({"u": np.repeat(names, len(names)), "v": np.tile(names, len(names)), "q": q.ravel()})

    def solve(edges: pd.DataFrame, columns: pd.DataFrame) -> pd.DataFrame:
        if columns.empty:
            return pd.DataFrame({"u": [], "v": [], "q": []})
        names = np.unique(pd.concat([edges["u"], edges["v"]]))
        i, j, asked = (np.searchsorted(names, c) for c in (edges["u"], edges["v"], columns["node"]))
        q = _solved(i, j, edges["p"].to_numpy(), len(names), asked, alpha, tolerance)
        return pd.DataFrame({"u": np.repeat(names, len(asked)), "v": np.tile(names[asked], len(names)), "q": q.ravel()})

    kind = dict(one.dtypes)["u"]
    small = tagged.where(F.col("n") <= largest).groupBy("component").applyInPandas(invert, f"u {kind}, v {kind}, q double")
    large = tagged.where(F.col("n") > largest)
    if large.isEmpty():
        return small
    turned = large.select("component", F.col("v").alias("u"), F.col("u").alias("v"), "p")
    both = large.select("component", "u", "v", "p").unionByName(turned).select("component", "u", "v", (F.lit(alpha) * F.col("p")).alias("c"), F.lit(1.0).alias("d"))
    rest, rows, inverse = _reduced(both, cover)
    if rows is not None:
        small = small.unionByName(_all_inverse(rows, inverse, "q"))
        rest = rest.select("component").distinct()
        large, counted = large.join(rest, "component", "left_semi"), counted.join(rest, "component", "left_semi")
        if large.isEmpty():
            return small
    # a task returns about half a million rows
    blocks = F.ceil(F.col("n") / F.greatest(F.lit(1.0), F.least(F.lit(256.0), F.floor(F.lit(500_000) / F.col("n"))))).cast("int")
    large = large.select("component", "u", "v", "p", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    columns = counted.where(F.col("n") > largest).select(F.col("component").alias("whole"), F.col("node").alias("node"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("part"))
    solved = large.select(F.col("component").alias("of"), F.col("u").alias("u"), F.col("v").alias("v"), F.col("p").alias("p"), F.col("block").alias("block")).groupBy("of", "block").cogroup(columns.groupBy("whole", "part")).applyInPandas(solve, f"u {kind}, v {kind}, q double")
    return small.unionByName(solved)


def bipartite_projection(position_rows: DataFrame) -> DataFrame:
    """(norm, side): the graph that splits each docket in its two sides, `docket||P` and `docket||R`."""
    return position_rows.select("norm", F.concat_ws("||", "docket", "position").alias("side")).distinct()
