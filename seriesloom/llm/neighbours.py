"""Approximate nearest neighbours by cosine: a forest of random-projection trees, one priority queue for all of them.

Equal vectors are one node, which keeps the ``k + 1`` smallest of its ids: no answer can hold others. A tree splits the nodes
level by level at the medians of their projections on a random direction of that level. Directions and medians come from
a bounded sample of nodes (``SAMPLE`` rows, ``SAMPLE_FLOATS`` numbers); every node is indexed, as a row of its leaf in each tree.

A query walks all trees from one queue, ordered by the distance to the nearest way it did not take: the next leaf is the
most promising one of any tree. It visits ``leaves`` leaves. Nodes and queries are dealt into cells, so a task holds about
``CELL`` members and ``CELL`` visitors at most (fewer if the vectors are long), and nothing is sent once for each tree or leaf:
a cell finds the leaves of its members and those that its visitors walk to by itself. Members and visitors of a leaf meet in
a matrix product in single precision, and what may be among a visitor's best is scored again in double precision, in one
order of summation, so a vector has one score wherever it is met. Ties are settled by the exact scores, however many there are.

How many leaves are enough depends on the vectors. ``fit`` searches the neighbours of at most ``PROBES`` queries in all nodes
by brute force, and asks at which turn of the queue each true neighbour's leaf would come. The budget is the turn by which the
share ``recall`` of them has come. With as few nodes as one leaf holds the search is exact.

Vectors that are null or empty or hold null or non-finite components or have no positive finite length take no part, nor do
rows without an id, nor vectors of another length than the commonest (the smaller of two as common). Repeated rows count
once; rows that share the query's id are its own. Equal scores go by the smaller id. Other columns are not read. Empty tables
and tables with one vector give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.tables import stored

TREES, LEAF = 8, 256
SAMPLE, SAMPLE_FLOATS = 1 << 16, 1 << 23
PROBES = 200
CELL, CELL_FLOATS = 1 << 17, 1 << 23
#: A cell has no fewer members than this only to occupy another core.
LEAST_CELL = 8192
#: A visitor holds so many members more than are wanted, by scores in single precision.
SPARE = 8
#: Numbers of a matrix product, of distances held at once, and bits of leaves reached.
PRODUCT, REACHED = 1 << 21, 1 << 26
#: So many candidates are taken over at once.
HITS = 1 << 17
#: Hot groups are first reduced in so many parts.
PARTS = 32


@dataclass(frozen=True)
class Forest:
    """``directions``: (trees * depth, length); ``medians``: for each tree the inner nodes by level, 2 ** depth - 1 numbers."""

    directions: np.ndarray
    medians: np.ndarray
    depth: int
    leaves: int  # leaves that a query visits

    def _margins(self, x: np.ndarray) -> np.ndarray:
        """Projections of unit vectors, (rows, trees, depth)."""
        return (x @ self.directions.T).reshape(len(x), len(self.medians), self.depth)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector in each tree, (rows, trees)."""
        p = self._margins(x)
        node = np.zeros((len(x), len(self.medians)), np.int64)
        tree = np.arange(len(self.medians))
        for level in range(self.depth):
            split = self.medians[tree, node + (1 << level) - 1]
            node = 2 * node + (p[:, :, level] >= split)
        return node

    def walk(self, p: np.ndarray, limit: int):
        """(tree, leaf) in the order of the shared queue, for the projections of one query."""
        queue = [(0.0, tree, 0, 0) for tree in range(len(p))]
        for _ in range(limit):
            if not queue:
                return
            far, tree, level, node = heapq.heappop(queue)
            while level < self.depth:
                gap = p[tree, level] - self.medians[tree, node + (1 << level) - 1]
                right = int(gap >= 0)
                heapq.heappush(queue, (max(far, abs(gap)), tree, level + 1, 2 * node + 1 - right))
                node = 2 * node + right
                level += 1
            yield tree, node

    @property
    def codes(self) -> int:
        """Leaves of all trees; without any split one tree says all."""
        return len(self.medians) << self.depth if self.depth else 1

    def code_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector in each tree, as a place among all leaves."""
        if not self.depth:
            return np.zeros((len(x), 1), np.int64)
        return self.leaf_of(x) + (np.arange(len(self.medians)) << self.depth)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """How far each leaf of any tree is in the queue of each unit vector, (rows, codes); found level by level."""
        if not self.depth:
            return np.zeros((len(x), 1))
        p, far = self._margins(x), np.zeros((len(x), len(self.medians), 1))
        for level in range(self.depth):
            gap = p[:, :, level, None] - self.medians[None, :, (1 << level) - 1 : (2 << level) - 1]
            away, right = np.maximum(far, np.abs(gap)), gap >= 0
            far = np.stack([np.where(right, away, far), np.where(right, far, away)], axis=-1).reshape(len(x), len(self.medians), -1)
        return far.reshape(len(x), -1)

    def reached(self, x: np.ndarray) -> np.ndarray:
        """(codes, rows): whether a leaf is among the first ``leaves`` of the queue of a unit vector."""
        out = np.ones((self.codes, len(x)), bool)
        if self.leaves >= self.codes:
            return out
        step = max(1, PRODUCT // self.codes)
        for at in range(0, len(x), step):
            far = self.distances(x[at : at + step])
            edge = np.partition(far, self.leaves - 1, axis=1)[:, self.leaves - 1 : self.leaves]
            seen, tied = far < edge, far == edge
            seen |= tied & (np.cumsum(tied, axis=1) <= self.leaves - seen.sum(axis=1, keepdims=True))
            out[:, at : at + step] = seen.T
        return out


def grow(sample: np.ndarray, nodes: int, trees: int = TREES, leaf: int = LEAF) -> Forest:
    """Trees from a sample of unit vectors, for so many nodes in all."""
    depth = max(0, round(np.log2(max(1, nodes) / leaf)))
    depth = min(depth, int(np.log2(max(1, len(sample) / 8))))
    rng = np.random.default_rng(11)
    directions = rng.standard_normal((trees * depth, sample.shape[1])) if depth else np.zeros((0, sample.shape[1]))
    directions /= np.maximum(1e-300, np.linalg.norm(directions, axis=1, keepdims=True))
    medians = np.zeros((trees, (1 << depth) - 1))
    p = (sample @ directions.T).reshape(len(sample), trees, depth)
    for tree in range(trees):
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            at = p[:, tree, level]
            split = pd.Series(at).groupby(node).median().reindex(range(1 << level)).fillna(0.0).to_numpy()
            medians[tree, (1 << level) - 1 : (2 << level) - 1] = split
            node = 2 * node + (at >= split[node])
    return Forest(directions, medians, depth, trees << depth)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are equally long, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x


def _best(queries: np.ndarray, members: np.ndarray, names: np.ndarray, k: int):
    """For each query vector the places of its ``k`` nearest members, equal scores by name, and their exact cosines."""
    near = _unit(queries) @ _unit(members).T
    kept = min(k, len(members))
    least = np.partition(near, len(members) - kept, axis=1)[:, len(members) - kept]
    square = (members * members).sum(axis=1)
    for row, q in enumerate(queries):
        at = np.flatnonzero(near[row] >= least[row] - 1e-12)
        exact = (members[at] * q).sum(axis=1) / (np.sqrt(square[at]) * np.sqrt((q * q).sum()))
        order = np.lexsort((names[at], -exact))[:kept]
        yield row, at[order], exact[order]


class Nodes:
    """The distinct vectors of a table: ``node`` (a 128-bit name), ``first`` id, ``ids`` (at most k + 1), ``v``."""

    def __init__(self, vectors: DataFrame, k: int, id_column: str, vector_column: str) -> None:
        single = dict(vectors.dtypes)[vector_column] == "array<float>"
        self.type = "array<float>" if single else "array<double>"
        v = F.col(vector_column).cast(self.type)
        rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where((F.size("v") > 0) & finite)
        rows = rows.where((square > 0) & (square < float("inf")))
        sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
        self.length = sizes["size"] if sizes else 0
        rows = rows.where(F.size("v") == self.length)
        self.rows = rows.withColumn("node", F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(7), "v"))))
        part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
        few = self.rows.select("node", "id", "v").dropDuplicates(["node", "id"]).withColumn("part", part)
        for keys in (("node", "part"), ("node",)):
            place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
            few = few.withColumn("place", place).where(F.col("place") <= k + 1)
        few = few.groupBy("node").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("v", "id").alias("v"))
        self.frame = stored(few.select("node", F.element_at("ids", 1).alias("first"), "ids", "v"), "nodes")
        self.count = self.frame.count()

    def of(self, is_query: Column) -> DataFrame:
        """``id, node`` of the rows that ask."""
        return self.rows.where(is_query).select("id", "node").distinct()


def _probe(probes: np.ndarray, k: int, forest: Forest) -> Callable:
    """Nodes to (probe, node, score, leaf in each tree): each task's ``k`` nearest nodes of every probe."""

    def run(batches):
        best: list[tuple] = []
        for batch in batches:
            x, names = _matrix(batch.column(1)), np.array(batch.column(0).to_pylist(), dtype=object)
            if not len(x):
                continue
            leaf = forest.leaf_of(_unit(x))
            for row, at, score in _best(probes, x, names, k):
                best += [(row, names[i], float(s), leaf[i].tolist()) for i, s in zip(at, score, strict=True)]
            best.sort(key=lambda r: (r[0], -r[2], r[1]))
            kept, seen = [], {}
            for r in best:
                seen[r[0]] = seen.get(r[0], 0) + 1
                if seen[r[0]] <= k:
                    kept.append(r)
            best = kept
        for at in range(0, len(best), 4096):
            cols = list(zip(*best[at : at + 4096], strict=True))
            kinds = (pa.int32(), pa.string(), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["probe", "node", "score", "leaf"]
            )

    return run


def fit(
    nodes: Nodes, asked: DataFrame, k: int, trees: int = TREES, leaf: int = LEAF, recall: float = 0.96, probes: int = PROBES
) -> Forest:
    """A forest over the nodes, with the budget that finds the share ``recall`` of the neighbours of the probes."""
    if not nodes.count:
        return Forest(np.zeros((0, 0)), np.zeros((trees, 0)), 0, 1)
    rows = int(max(1, min(SAMPLE, SAMPLE_FLOATS // max(1, nodes.length))))

    def some(frame: DataFrame, n: int, salt: int) -> np.ndarray:
        # node names are hashes; the filter leaves about twice as many as wanted, so the sort sees few rows
        share = min(1.0, 2.0 * n / max(1, nodes.count))
        drawn = F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(1 << 30))
        rows_ = frame.select(drawn.alias("u"), "node", "v").where(F.col("u") < int(share * (1 << 30)) + 1)
        got = rows_.orderBy("u", "node").limit(n).select("v").toArrow()
        return _matrix(got.column(0).combine_chunks()) if got.num_rows else np.zeros((0, nodes.length))

    forest = grow(_unit(some(nodes.frame, rows, 1)), nodes.count, trees, leaf)
    if not forest.depth:
        return forest
    few = asked.select("node").distinct().orderBy(F.xxhash64("node", F.lit(2))).limit(probes)
    got = nodes.frame.join(F.broadcast(few), "node").select("v").toArrow()
    x = _matrix(got.column(0).combine_chunks()) if got.num_rows else np.zeros((0, nodes.length))
    if not len(x):
        return forest
    found = nodes.frame.select("node", "v").mapInArrow(
        _probe(x, k + 1, forest), "probe int, node string, score double, leaf array<long>"
    )
    for keys in (("probe", "part"), ("probe",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "node"))
        part = F.pmod(F.xxhash64("node"), F.lit(PARTS))
        found = found.withColumn("part", part).withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    true = found.select("probe", "score", "leaf").collect()  # probes * (k + 1) rows
    turns = []
    by_probe: dict[int, list] = {}
    for r in sorted(true, key=lambda r: -r["score"]):
        by_probe.setdefault(r["probe"], []).append(r["leaf"])
    for probe, leaves in by_probe.items():
        turn = np.empty(forest.codes, np.int64)
        turn[np.argsort(forest.distances(_unit(x[probe : probe + 1]))[0], kind="stable")] = np.arange(1, forest.codes + 1)
        turns += [min(turn[(tree << forest.depth) + leaf] for tree, leaf in enumerate(own)) for own in leaves[1:]]  # the first is the probe
    if not turns:
        return forest
    budget = int(np.sort(turns)[min(len(turns) - 1, int(np.ceil(recall * len(turns))) - 1)])
    return Forest(forest.directions, forest.medians, forest.depth, budget)


_BEST = "asked string, best array<struct<far: double, first: long, node: string>>"


def _cosines(members: np.ndarray, square: np.ndarray, at: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact cosines of each query with its members ``at``."""
    exact = np.empty(at.shape)
    for i in range(0, len(at), 512):
        q, own = queries[i : i + 512], at[i : i + 512]
        exact[i : i + 512] = (members[own] * q[:, None, :]).sum(axis=2) / (np.sqrt(square[own]) * np.sqrt((q * q).sum(axis=1))[:, None])
    return exact


def _met(forest: Forest, members: np.ndarray, names: np.ndarray, k: int) -> Callable:
    """Queries to (places, scores, count): the ``k`` best of the members in the leaves that each of them visits."""
    x, square = _unit(members), (members * members).sum(axis=1)
    code = forest.code_of(x)
    x = x.astype(np.float32)
    flat = code.T.ravel()
    order = np.argsort(flat, kind="stable")
    found, starts = np.unique(flat[order], return_index=True)
    leaves = list(zip(found.tolist(), np.split(order % len(x), starts[1:]), strict=True))
    hold = k + SPARE
    error = 4e-7 * (members.shape[1] + 8)

    def run(queries: np.ndarray):
        unit = _unit(queries)
        seen = forest.reached(unit)
        q = unit.astype(np.float32)
        top, at = np.full((len(q), hold), -np.inf, np.float32), np.full((len(q), hold), -1, np.int64)
        least = np.full(len(q), -np.inf, np.float32)
        hits: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def settle() -> None:
            """Take the hits over into the best of each visitor, each member once however many trees it was met in."""
            rows = np.unique(np.concatenate([h[0] for h in hits]))
            held = at[rows] >= 0
            v = np.concatenate([*(h[0] for h in hits), np.repeat(rows, held.sum(axis=1))])
            m = np.concatenate([*(h[1] for h in hits), at[rows][held]])
            score = np.concatenate([*(h[2] for h in hits), top[rows][held]])
            hits.clear()
            one = np.unique(v * len(x) + m, return_index=True)[1]
            one = one[np.lexsort((-score[one], v[one]))]
            v, m, score = v[one], m[one], score[one]
            rank = np.arange(len(v)) - np.searchsorted(v, v)
            best = rank < hold
            top[rows], at[rows] = -np.inf, -1
            top[v[best], rank[best]], at[v[best], rank[best]] = score[best], m[best]
            least[rows] = top[rows, -1]

        for leaf, own in leaves:
            visitors, mine = np.flatnonzero(seen[leaf]), x[own].T
            step = max(1, PRODUCT // len(own))
            for i in range(0, len(visitors), step):
                v = visitors[i : i + step]
                near, floor = q[v] @ mine, least[v]
                new = np.flatnonzero(np.isneginf(floor)) if len(own) > hold else []
                if len(new):  # of one leaf no more than can be held, and what equals the last of them
                    floor[new] = np.nextafter(np.partition(near[new], len(own) - hold, axis=1)[:, len(own) - hold], np.float32(-np.inf))
                row, col = np.divmod(np.flatnonzero(near > floor[:, None]), len(own))
                if len(row):
                    hits.append((v[row], own[col], near[row, col]))
                    waiting += len(row)
                if waiting >= HITS:
                    settle()
                    waiting = 0
        if hits:
            settle()
        exact = np.where(at >= 0, _cosines(members, square, at, queries), -np.inf)
        order = np.lexsort((names[at], -exact), axis=1)[:, :k]
        at, exact = np.take_along_axis(at, order, axis=1), np.take_along_axis(exact, order, axis=1)
        # what was dropped scores ``least`` at most in single precision; where that may be among the best, all are scored
        for i in np.flatnonzero((least > -np.inf) & (least + error >= exact[:, -1])):
            own = np.flatnonzero(seen[code, i].any(axis=1))
            near = x[own] @ q[i]
            own = own[near >= np.partition(near, len(own) - k)[len(own) - k] - 2 * error]
            score = _cosines(members, square, own[None], queries[i : i + 1])[0]
            best = np.lexsort((names[own], -score))[:k]
            at[i], exact[i] = own[best], score[best]
        return at, exact, (at >= 0).sum(axis=1)

    return run


def _cell(forest: Forest, k: int) -> Callable:
    """The best members of one cell, one row for each of its visitors."""

    def run(members: pa.Table, visitors: pa.Table) -> pa.Table:
        asked, found = [pa.array([], pa.string())], []
        if members.num_rows and visitors.num_rows:
            first, node = members.column("first").to_numpy(), members.column("node").combine_chunks()
            met = _met(forest, _matrix(members.column("v").combine_chunks()), first, k)
            step = max(64, REACHED // forest.codes)
            for i in range(0, visitors.num_rows, step):
                part = visitors.slice(i, step)
                at, score, count = met(_matrix(part.column("v").combine_chunks()))
                asked.append(part.column("node").combine_chunks())
                there = at >= 0
                own = at[there]
                best = pa.StructArray.from_arrays([pa.array(-score[there]), pa.array(first[own]), node.take(pa.array(own))], ["far", "first", "node"])
                found.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count], dtype=np.int32)), best))
        kind = pa.list_(pa.struct([("far", pa.float64()), ("first", pa.int64()), ("node", pa.string())]))
        return pa.table({"asked": pa.chunked_array(asked, pa.string()), "best": pa.chunked_array(found, kind)})

    return run


def _dealt(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """Rows dealt into cells: by themselves along one side, copied along the other."""
    rows = rows.withColumn(own, F.pmod(F.xxhash64("node"), F.lit(n_own)).cast("int"))
    return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    trees: int = TREES,
    leaf: int = LEAF,
    recall: float = 0.96,
) -> DataFrame:
    """``query_id, rank, id, score`` of the ``k`` nearest rows found for each row with ``is_query`` (a condition on ``id``)."""
    nodes = Nodes(vectors, k, id_column, vector_column)
    queries = nodes.of(is_query)
    forest = fit(nodes, queries, k, trees, leaf, recall)
    asked = nodes.frame.select("node", "v").join(queries.select("node").distinct(), "node", "left_semi")
    asked = stored(asked, "asked")
    most = max(1, min(CELL, CELL_FLOATS // max(1, nodes.length)))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_members = max(1, -(-nodes.count // most), min(2 * cores, nodes.count // LEAST_CELL))
    n_visitors = max(1, -(-asked.count() // most))
    here = _dealt(nodes.frame.select("node", "first", "v"), "members", n_members, "visitors", n_visitors)
    there = _dealt(asked, "visitors", n_visitors, "members", n_members)
    cell = ["members", "visitors"]
    met = here.groupBy(*cell).cogroup(there.groupBy(*cell)).applyInArrow(_cell(forest, k + 1), _BEST)
    # a node is in one cell with a query, so the k + 1 best of all cells are among the k + 1 best of each
    best = met.groupBy("asked").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))
    best = best.select("asked", F.explode("best").alias("b")).select("asked", (-F.col("b.far")).alias("score"), "b.node")
    best = best.join(nodes.frame.select("node", "ids"), "node")
    # at most (k + 1) ** 2 pairs for each node that asks; its k + 1 best ids serve all rows that are copies of it
    pairs = best.select("asked", "score", F.explode("ids").alias("id"))
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "id"))
    pairs = pairs.withColumn("place", place).where(F.col("place") <= k + 1)
    found = pairs.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("found"))
    mine = queries.withColumnRenamed("id", "query_id").withColumnRenamed("node", "asked").join(found, "asked")
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    return mine.select("query_id", F.posexplode(others).alias("at", "f")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.id").alias("id"), F.col("f.score").alias("score")
    )
