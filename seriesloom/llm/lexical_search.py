"""Ranked lexical search of many items at once, with common subexpressions evaluated once.

A document's score for an item is a sum over the item's terms. Items share terms, so the sums share parts. Over a block of
items, terms held by the same items become one node; then pairs of nodes that stand side by side in several items (nodes in
one order for all items, the most shared first) become a node of their own, the most frequent pairs first, until no pair
repeats. The result is a graph without cycles in which an item is a short list of nodes. For every document each term's part
is computed once, each node once from its two parts, level by level, and the items are sums of nodes.

The work on the corpus:

1. one pass counts the terms of each text and writes those that an item may have (a bit table of bounded size);
2. one aggregation counts documents, terms and document frequencies;
3. for each block of items (``TERMS`` item terms at most, or one item), one pass over the counts evaluates the graph for blocks of
   documents as whole-number matrices; a task keeps its best ``k`` documents of each item, and the best of these are the answer.

No pair of item and document leaves a task but those ``k``. All score arithmetic is in 64-bit integers.

A null text has no terms. Every row is a document or an item of its own, also when its id or the whole row repeats; then ranks
go by id, null last, and are given per item row. Items without a term in any document give no rows. Other columns are not
read. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.decontaminate import BitTable
from seriesloom.llm.shingles import alnum_words, hash_words
from seriesloom.llm.tables import stored

#: Item terms in a block of items, and numbers in a matrix of (nodes, documents).
TERMS, CELLS = 1 << 15, 1 << 21
#: Results of tasks are first reduced in so many parts.
PARTS = 64


# -- counting -------------------------------------------------------------------------------------------------------------
def _item_terms(batches):
    for batch in batches:
        items, terms, hashes = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = sorted(set(alnum_words(text)))
            items += [item] * len(own)
            terms += own
            hashes.append(hash_words(own).view(np.int64))
        token = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()), pa.array(terms, pa.binary()), pa.array(token)], names=["item", "term", "token"]
        )


def _counts(table: BitTable) -> Callable:
    """(doc_id, text) to the number of terms, and the terms that an item may have with their counts."""

    def run(batches):
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column(1):
                words = alnum_words(text.as_py())
                sizes.append(len(words))
                found = Counter(words)
                names = list(found)
                has = table.has(hash_words(names)) if names else np.zeros(0, bool)
                terms.append([names[i] for i in np.flatnonzero(has)])
                counts.append([found[t] for t in terms[-1]])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(terms, pa.list_(pa.binary())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    return run


# -- the graph of shared sums ---------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Graph:
    """Nodes 0 ... len(terms) - 1 are terms; then come sums of terms of one signature, then sums of two nodes.

    ``groups``: terms of each signature node; ``levels``: for each level (left, right) of its nodes, numbered on; ``items``: the
    nodes of each item.
    """

    groups: list[list[int]]
    levels: list[tuple[np.ndarray, np.ndarray]]
    items: list[list[int]]

    @property
    def size(self) -> int:
        return len(self.groups) + sum(len(left) for left, _ in self.levels)

    def scores(self, parts: np.ndarray) -> np.ndarray:
        """(items, documents) from the parts (terms, documents)."""
        nodes = np.zeros((self.size, parts.shape[1]), np.int64)
        flat = np.array([t for g in self.groups for t in g], np.int64)
        starts = np.cumsum([0, *[len(g) for g in self.groups]])[:-1]
        nodes[: len(self.groups)] = np.add.reduceat(parts[flat], starts, axis=0)
        at = len(self.groups)
        for left, right in self.levels:
            nodes[at : at + len(left)] = nodes[left] + nodes[right]
            at += len(left)
        flat = np.array([n for i in self.items for n in i], np.int64)
        starts = np.cumsum([0, *[len(i) for i in self.items]])[:-1]
        return np.add.reduceat(nodes[flat], starts, axis=0)


def mine(items: list[list[int]]) -> Graph:
    """The graph for items given as lists of terms (numbers from 0, each in some item; no list is empty)."""
    holders: dict[int, list[int]] = {}
    for i, terms in enumerate(items):
        for t in terms:
            holders.setdefault(t, []).append(i)
    signature: dict[tuple[int, ...], list[int]] = {}
    for t in sorted(holders):
        signature.setdefault(tuple(holders[t]), []).append(t)
    shared = sorted(signature, key=lambda s: (-len(s), s))
    lists: list[list[int]] = [[] for _ in items]
    for node, held_by in enumerate(shared):
        for i in held_by:
            lists[i].append(node)
    size, levels = len(shared), []
    while True:
        pairs = Counter(p for nodes in lists for p in set(zip(nodes, nodes[1:], strict=False)))
        chosen = {p for p, n in pairs.items() if n > 1}
        if not chosen:
            break
        rank = {p: r for r, p in enumerate(sorted(chosen, key=lambda p: (-pairs[p], p)))}
        name: dict[tuple[int, int], int] = {}
        for i, nodes in enumerate(lists):
            taken, used = {}, set()
            for p in sorted((p for p in zip(nodes, nodes[1:], strict=False) if p in rank), key=rank.__getitem__):
                if not used.intersection(p):
                    used.update(p)
                    taken[p[0]] = name.setdefault(p, size + len(name))
            out, skip = [], False
            for node in nodes:
                if skip:
                    skip = False
                elif node in taken:
                    out.append(taken[node])
                    skip = True
                else:
                    out.append(node)
            lists[i] = out
        made = sorted(name, key=name.__getitem__)
        levels.append((np.array([p[0] for p in made], np.int64), np.array([p[1] for p in made], np.int64)))
        size += len(made)
    return Graph([signature[s] for s in shared], levels, lists)


# -- evaluation -----------------------------------------------------------------------------------------------------------
def _evaluate(vocabulary: dict[bytes, int], weight: np.ndarray, names: np.ndarray, graph: Graph, n_docs: int, n_terms: int, k: int):
    """Rows (doc_id, n, terms, counts) to each task's ``k`` best (item, doc_id, score)."""

    def run(batches):
        best: list[list[tuple]] = [[] for _ in graph.items]  # heaps: (score, id descending, null lowest), the worst on top
        step = max(1, CELLS // (len(weight) + graph.size))

        def take(ids, scores) -> None:
            floor = np.array([h[0][0] if len(h) == k else 1 for h in best], np.int64)
            for i, d in zip(*np.nonzero(scores >= floor[:, None]), strict=True):
                doc = ids[d]
                row = (int(scores[i, d]), doc is not None, 0 if doc is None else -doc)
                if len(best[i]) < k:
                    heapq.heappush(best[i], row)
                elif row > best[i][0]:
                    heapq.heapreplace(best[i], row)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows, cols, tf = [], [], []
                for d, (terms, counts) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    for t, c in zip(terms, counts, strict=True):
                        row = vocabulary.get(t)
                        if row is not None:
                            rows.append(row)
                            cols.append(d)
                            tf.append(c)
                if not rows:
                    continue
                row, col, tf = (np.array(x, np.int64) for x in (rows, cols, tf))
                # 90 * n * N may pass 64 bits in a corpus of 100 TB, so this one division is done on Python's whole numbers
                m = np.array([10 + (90 * n * n_docs) // n_terms for n in part.column(1).to_pylist()], np.int64)
                parts = np.zeros((len(weight), part.num_rows), np.int64)
                parts[row, col] = weight[row] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[col]))
                take(ids[at : at + part.num_rows], graph.scores(parts))
        flat = [(int(names[i]), -d if known else None, s) for i, h in enumerate(best) for s, known, d in h]
        for at in range(0, len(flat), 1 << 14):
            cols = zip(*flat[at : at + (1 << 14)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents (``doc_id``, ``text``) of each item (``item_id``, ``text``)."""
    spark = docs.sparkSession
    numbered = stored(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    terms = stored(
        numbered.select("item", "text").mapInArrow(_item_terms, "item long, term binary, token long"), "item-terms"
    )
    table = BitTable.of(terms.select("token"))
    counted = docs.select("doc_id", "text").mapInArrow(
        _counts(table), "doc_id long, n long, terms array<binary>, counts array<long>"
    )
    counted = stored(counted.where("n > 0"), "term-counts")
    total = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ratio = F.lit(2.0 * total["docs"] + 2) / (2 * F.col("df") + 1)
    weight = F.floor(1000 * F.log(ratio)).cast("long")
    known = terms.join(frequency, "term").select("item", "term", weight.alias("weight"))
    n_terms = terms.count()
    blocks = max(1, -(-n_terms // block))
    known = stored(known.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")), "weighted-terms")

    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for b in range(blocks):
        # a block holds about `block` rows, as items are dealt by hash
        rows = known.where(F.col("block") == b).select("item", "term", "weight").collect()
        if not rows:
            continue
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        weights = np.zeros(len(vocabulary), np.int64)
        lists: dict[int, list[int]] = {}
        for r in rows:
            at = vocabulary[bytes(r["term"])]
            weights[at] = r["weight"]
            lists.setdefault(r["item"], []).append(at)
        names = np.array(sorted(lists), np.int64)
        graph = mine([sorted(lists[i]) for i in names.tolist()])
        run = _evaluate(vocabulary, weights, names, graph, total["docs"], total["terms"], k)
        top = counted.mapInArrow(run, "item long, doc_id long, score long")
        found = found.unionByName(top if blocks == 1 else stored(top, "block-results"))
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))
    for keys in (("item", "part"), ("item",)):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("part", part).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
