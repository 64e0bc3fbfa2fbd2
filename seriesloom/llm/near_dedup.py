"""Near-duplicate documents by one-permutation MinHash with optimal densification.

A document's word shingles are hashed once; the hash range is cut into ``BINS`` bins and each bin keeps its smallest
hash. An empty bin takes the value of the first filled bin in a fixed random order of its own (optimal densification), so
bins stay independent of each other however few shingles there are. ``ROWS`` bins make a band; documents that agree in a
band share a bucket.

Candidates are stars: a bucket links its members to one centre, so a bucket of n members gives n - 1 edges. What a star
cannot show is searched for in turn: buckets whose members fell into more than one component get stars around other
centres, and the members of buckets that are mixed even then are compared by an exact prefix-filtered join. Each link is
confirmed on the full shingle sets; equal sets are one node throughout.

Two documents of similarity s share no bucket with a chance of (1 - s**ROWS)**(BINS/ROWS), 4e-7 at 0.8.

Nulls, empty texts and texts without words have no shingles and are linked with nothing. A null id takes no part and
stays (component null, kept true). Nodes are sets, not ids: rows of one id with different texts are compared each by its own
text and may be in different groups, and repeated rows get the same component. A group is named by the smallest id of its
rows. Other columns of the input are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.components import components
from seriesloom.llm.shingles import A, B, blank_words, blocks, distinct, hash_words, mix, shingle_hashes
from seriesloom.llm.tables import stored

ROWS = 8
BINS = 640
#: Shingles of more nodes than this are brought to the nodes, if there are no more of them than that (16 bytes each).
HOT, MOST_HOT = 256, 500_000
_ORDER: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin the order in which it tries the others, and the rank of each bin in that order."""
    if bins not in _ORDER:
        x = mix(np.arange(1, bins * bins + 1, dtype=np.uint64) * A).reshape(bins, bins)
        order = np.argsort(x, axis=1, kind="stable").astype(np.int32)
        _ORDER[bins] = order, np.argsort(order, axis=1).astype(np.int32)
    return _ORDER[bins]


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One value per bin from sorted distinct hashes (at least one)."""
    order, rank = _orders(bins)
    bin_of = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]])
    filled = bin_of[first]
    source = np.full(bins, -1, np.int64)
    source[filled] = filled
    values = np.zeros(bins, np.uint64)
    values[filled] = hashes[first]
    empty = np.flatnonzero(source < 0)
    if len(filled) <= 24:
        source[empty] = filled[rank[empty][:, filled].argmin(axis=1)]
    else:
        has = source >= 0
        t = 0
        while len(empty):
            to = order[empty, t]
            hit = has[to]
            source[empty[hit]] = to[hit]
            empty = empty[~hit]
            t += 1
    return values[source]


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    bands = values.reshape(-1, rows)
    x = np.arange(1, len(bands) + 1, dtype=np.uint64) * A
    for j in range(rows):
        x = mix(x + bands[:, j] * B)
    return x


def shingle_set(words: list[bytes], h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``width`` are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    return distinct(shingle_hashes(h, min(width, len(words))))


def _sets(texts: list[str | None], width: int):
    """The shingle set of each text, in order."""
    for part in blocks(texts):
        words = [blank_words(texts[i]) for i in part]
        h = hash_words([w for ws in words for w in ws])
        at = 0
        for ws in words:
            yield shingle_set(ws, h[at : at + len(ws)], width)
            at += len(ws)


_SKETCH = "doc_id long, text_key long, n_shingles long, set_hash binary, bands array<long>"


def _sketch(width: int, bins: int, rows: int) -> Callable:
    def run(batches):
        for batch in batches:
            sizes, hashes, bands = [], [], []
            for s in _sets(batch.column(2).to_pylist(), width):
                sizes.append(len(s))
                hashes.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(signature(s, bins), rows).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(hashes, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "n_shingles", "set_hash", "bands"],
            )

    return run


def _verify(width: int, percent: int) -> Callable:
    """Keep the pairs (a, b) whose texts are similar enough. Rows arrive sorted by a, so its set is made once."""

    def run(batches):
        known, known_set = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1)
            keep = np.zeros(len(a), bool)
            text_a = batch.column(2)
            for i, (x, other) in enumerate(zip(a, _sets(batch.column(3).to_pylist(), width), strict=True)):
                if x != known:
                    known, known_set = x, next(_sets([text_a[i].as_py()], width))
                if min(len(known_set), len(other)) * 100 < percent * max(len(known_set), len(other)):
                    continue
                both = len(known_set) + len(other) - len(distinct(np.concatenate([known_set, other])))
                keep[i] = 100 * both >= percent * (len(known_set) + len(other) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), b.filter(mask)], names=["a", "b"])

    return run


def _tokens(width: int) -> Callable:
    def run(batches):
        for batch in batches:
            sets = list(_sets(batch.column(2).to_pylist(), width))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["node", "label", "n", "tokens"],
            )

    return run


def _class(n: Column) -> Column:
    """Sizes within about two percent of each other are one class."""
    return F.floor(F.log(F.greatest(n, F.lit(1))) / math.log(1.02)).cast("int")


class _Search:
    """The nodes (one per distinct shingle set), their buckets, and the confirmed links between them."""

    def __init__(self, docs: DataFrame, sketch: DataFrame, width: int, percent: int) -> None:
        self.width, self.percent = width, percent
        nodes = sketch.where("doc_id IS NOT NULL AND set_hash IS NOT NULL")
        # one row stands for each set; the numbers are written, so they stay the same
        one = nodes.groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_key", "row")).alias("first"))
        one = one.select("set_hash", "first.*", F.monotonically_increasing_id().alias("node"))
        self.sets = stored(one, "sets")
        one = nodes.select("row", "bands", "n_shingles").join(self.sets.select("row", "node"), "row")
        keys = one.select(F.explode("bands").alias("key"), "node", "n_shingles")
        shared = (
            keys.groupBy("key")
            .agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n"))
            .where("first != last")
        )
        self.members = stored(keys.join(shared.select("key"), "key"), "buckets")
        named = self.sets.join(self.members.select("node").distinct(), "node").select("node", "doc_id", "text_key")
        rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).join(named, ["doc_id", "text_key"])
        self.texts = stored(rows.groupBy("node").agg(F.min("text").alias("text")), "texts")
        self.labels: DataFrame | None = None

    def labelled(self) -> DataFrame:
        """Members of the buckets that hold more than one component: key, node, n_shingles, label."""
        at = self.members
        if self.labels is None:
            return at.withColumn("label", F.col("node"))
        at = at.join(self.labels.withColumnRenamed("component", "label"), "node", "left").withColumn(
            "label", F.coalesce("label", "node")
        )
        mixed = at.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
        return at.join(mixed.select("key"), "key", "left_semi")

    def confirm(self, pairs: DataFrame) -> None:
        """Compare the sets of ``pairs`` (a, b) and bring labels up to date."""
        a = self.texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        b = self.texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        full = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
        found = stored(full.mapInArrow(_verify(self.width, self.percent), "a long, b long"), "links")
        if self.labels is not None:  # what is connected already is one edge for each node
            if found.isEmpty():
                return
            known = self.labels.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = known.unionByName(found)
        self.labels = stored(components(found), "labels")

    def sized(self, x: str, y: str):
        """Sets whose sizes differ too much cannot be similar."""
        return F.least(x, y) * 100 >= F.greatest(x, y) * self.percent

    def star(self, round_: int) -> bool:
        """Link each member of a mixed bucket to the bucket's centre; false if no bucket is mixed."""
        at = stored(self.labelled(), "mixed") if round_ else self.labelled()
        if round_ and at.isEmpty():
            return False
        rank = F.xxhash64("node", F.lit(round_)) if round_ else F.col("node")
        centre = at.groupBy("key").agg(F.min(F.struct(rank.alias("r"), "node", "label", "n_shingles")).alias("c"))
        edges = at.join(centre, "key").where(F.col("label") != F.col("c.label"))
        edges = edges.where(self.sized("n_shingles", "c.n_shingles"))
        if round_:
            pairs = edges.select(
                F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")
            ).distinct()
        else:  # one centre for each: the smallest of its buckets
            pairs = edges.groupBy(F.col("node").alias("b")).agg(F.min("c.node").alias("a")).select("a", "b")
        self.confirm(pairs)
        return True

    def rest(self) -> None:
        """Compare what shares a mixed bucket and may still be linked, found by a prefix filter.

        Linked sets agree in one of their rarest shingles: of n shingles the n - ceil(percent * n / 100) + 1 rarest are
        enough to ask. In a group of copies the shingles that all share are frequent, so a copy that differs too much to
        be linked has a prefix of its own and meets nobody. Per shingle, pairs are made from the nodes outside its
        commonest component only, as the others are connected already.
        """
        at = self.labelled().select("node", "label").distinct()
        rows = at.join(self.texts, "node").mapInArrow(_tokens(self.width), "node long, label long, n int, tokens array<long>")
        sets = stored(rows, "tokens")
        token = sets.select("node", "label", "n", F.explode("tokens").alias("token"))
        spread = token.groupBy("token").agg(
            F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")
        )
        by_rarity = Window.partitionBy("node").orderBy("df", "token")
        prefix = (
            _with_counts(token, stored(spread, "token-counts"))
            .withColumn("rank", F.row_number().over(by_rarity))
            .where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1)
            .where("lo != hi")
            .select("token", "node", "label", "n", "rank")
        )
        prefix = stored(prefix, "prefix")
        common = prefix.groupBy("token", "label").count().groupBy("token").agg(
            F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("df")
        )
        # what two sets can share from this shingle on must be enough; so a rank leaves only some sizes for the other set
        p = self.percent
        most = F.floor((F.col("nx") - F.col("rx") + 1) * (100 + p) / p).cast("int") - F.col("nx")
        x = (
            _with_counts(prefix, stored(common, "commonest"))
            .where("label != top.label")
            .select("token", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("rank").alias("rx"))
            .withColumn("most", most)
            .where(F.col("most") * 100 >= F.col("nx") * p)
            .withColumn("class", F.explode(F.sequence(_class(F.col("nx") * p / 100), _class(F.col("most")))))
        )
        y = prefix.select(
            "token",
            _class(F.col("n")).alias("class"),
            F.col("node").alias("y"),
            F.col("label").alias("ly"),
            F.col("n").alias("ny"),
            F.col("rank").alias("ry"),
        )
        left = F.least(F.col("nx") - F.col("rx"), F.col("ny") - F.col("ry")) + 1
        met = x.join(y, ["token", "class"]).where("lx != ly").where(self.sized("nx", "ny"))
        met = met.where(left * (100 + p) >= (F.col("nx") + F.col("ny")) * p)
        self.confirm(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def _with_counts(rows: DataFrame, counts: DataFrame, key: str = "token") -> DataFrame:
    """``rows`` with the counts (a row for each ``key``, ``df`` of how many rows) of their key. A key of many rows is brought
    to them; the rest meet by key, a few each.
    """
    hot = counts.where(F.col("df") > HOT)
    if hot.count() > MOST_HOT:
        return rows.join(counts, key)
    hot = F.broadcast(hot)
    cold = rows.join(hot.select(key), key, "left_anti").join(counts.where(F.col("df") <= HOT), key)
    return cold.unionByName(rows.join(hot, key))


def near_components(
    docs: DataFrame, width: int = 2, percent: int = 80, bins: int = BINS, rows: int = ROWS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_key, group`` for every row of ``docs`` (``doc_id`` long, ``text`` string).

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles.
    ``component_id`` is the smallest id reachable by links, ``kept`` is ``doc_id = component_id``. ``text_key`` is the hash of
    the text, ``group`` a number of the rows' group (null without words), which tells apart groups of one name.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    sketch = base.mapInArrow(_sketch(width, bins, rows), _SKETCH)
    sketch = stored(sketch.withColumn("row", F.monotonically_increasing_id()), "sketch")
    search = _Search(base, sketch, width, percent)
    search.star(0)
    if search.star(1):
        search.rest()
    labels = search.labels.withColumnRenamed("component", "group")
    linked = search.sets.join(labels, "node").select("set_hash", "group", "doc_id")
    least = stored(linked.groupBy("group").agg(F.min("doc_id").alias("_component"), F.count("*").alias("df")), "groups")
    linked = _with_counts(linked.drop("doc_id"), least, "group").drop("df")
    alone = search.sets.join(labels, "node", "left_anti")
    alone = alone.select("set_hash", F.col("node").alias("group"), F.col("doc_id").alias("_component"))
    named = linked.select("set_hash", "group", "_component").unionByName(alone)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return (
        sketch.drop("bands")
        .join(named, "set_hash", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"), "text_key", "group")
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
