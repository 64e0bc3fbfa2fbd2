"""Benchmark decontamination: which words of the documents lie inside windows of benchmark items.

A window is ``window`` consecutive words of an item, or the whole item if it has fewer. Windows are found by a
prefix-filtered join on shingles of five words (of fewer for shorter windows):

1. one pass over the documents keeps the runs of words all of whose shingles may occur in the benchmark (a bit table of
   bounded size; runs shorter than a window are dropped at once, the length bound). Any occurrence of a window lies inside
   one run, so everything after works on runs, which clean documents hardly have;
2. the shingles are ordered by rarity, counted over all documents; all shingles of a window must occur for the window to
   occur, so its rarest is a sufficient prefix, and a window with a shingle that no document has is dropped;
3. runs and windows meet on that shingle; its place in the window gives the place of the window in the run, which must
   lie inside the run (positional bound);
4. the words there are compared with the window's.

Null and empty texts have no words. Repeated rows get equal results; documents whose runs are equal are looked up once.
Items without words have no window. Items with a null id count for hit words, not for items. Other columns are not read.
Empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.shingles import alnum_words, blocks, hash_words, shingle_hashes
from seriesloom.llm.tables import stored

SHINGLE = 5
#: The bit table has 32 bits per shingle of the benchmark, and between these many.
MIN_BITS, MAX_BITS = 1 << 16, 1 << 27

_WINDOWS = "item_id string, window string, n int, k int, tokens array<long>"
_SCAN = (
    "doc_id long, n_words long, key binary, "
    "runs array<struct<k: int, start: int, words: array<string>, tokens: array<long>>>"
)


def _windows(window: int) -> Callable:
    """(item_id, text) to one row per window."""

    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = alnum_words(text)
                if not words:
                    continue
                n = min(window, len(words))
                k = min(SHINGLE, n)
                tokens = shingle_hashes(hash_words(words), k).view(np.int64)
                for i in range(len(words) - n + 1):
                    text_of = b" ".join(words[i : i + n]).decode("utf-8", "surrogatepass")
                    rows.append((item, text_of, n, k, tokens[i : i + n - k + 1].tolist()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item_id", "window", "n", "k", "tokens"]
            )

    return run


class BitTable:
    """A set of hashes as bits: never says no to a member."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    @classmethod
    def of(cls, tokens: DataFrame) -> BitTable:
        """From a column ``token``. What reaches the driver is the table itself, at most MAX_BITS / 8 bytes as longs."""
        n = tokens.select(F.approx_count_distinct("token")).first()[0]
        bits = MIN_BITS
        while bits < 32 * n and bits < MAX_BITS:
            bits *= 2
        low = F.col("token").bitwiseAND(F.lit(bits - 1))
        high = F.shiftrightunsigned("token", 32).bitwiseAND(F.lit(bits - 1))
        at = tokens.select(F.explode(F.array(low, high)).alias("bit"))
        words = at.groupBy(F.shiftright("bit", 6).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v")
        )
        table = np.zeros(bits // 64, np.uint64)
        for w, v in words.toLocalIterator():
            table[w] = np.uint64(v & 0xFFFFFFFFFFFFFFFF)
        return cls(table)

    def _bit(self, x: np.ndarray) -> np.ndarray:
        return (self.words[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self._bit(hashes & self.mask))
        out = np.zeros(len(hashes), bool)
        out[maybe] = self._bit((hashes[maybe] >> np.uint64(32)) & self.mask) == 1
        return out


def _scan(table: BitTable, shortest: dict[int, int]) -> Callable:
    """(doc_id, text) to word counts and runs. ``shortest``: for each shingle width, the words of its shortest window."""

    def runs_of(words: list[bytes], h: np.ndarray) -> list[dict]:
        found = []
        for k, n in shortest.items():
            x = shingle_hashes(h, k)
            ok = table.has(x)
            if not ok.any():
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, ok, False].astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a + k - 1 >= n:
                    part = [w.decode("utf-8", "surrogatepass") for w in words[a : b + k - 1]]
                    found.append({"k": k, "start": a, "words": part, "tokens": x[a:b].view(np.int64).tolist()})
        return found

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts, keys, runs = [], [], []
            for part in blocks(texts):
                words = [alnum_words(texts[i]) for i in part]
                h = hash_words([w for ws in words for w in ws])
                at = 0
                for ws in words:
                    found = runs_of(ws, h[at : at + len(ws)])
                    at += len(ws)
                    counts.append(len(ws))
                    runs.append(found or None)
                    name = json.dumps([(r["k"], r["start"], r["words"]) for r in found]).encode()
                    keys.append(blake2b(name, digest_size=16).digest() if found else None)
            item = pa.struct(
                [("k", pa.int32()), ("start", pa.int32()), ("words", pa.list_(pa.string())), ("tokens", pa.list_(pa.int64()))]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(runs, pa.list_(item))],
                names=["doc_id", "n_words", "key", "runs"],
            )

    return run


def _occurrences(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """``key, start, n, window``: where windows occur in the documents that have the runs of ``key``."""
    run = runs.select("key", "docs", F.posexplode("runs").alias("run", "r"))
    token = run.select("key", "docs", "run", F.col("r.k").alias("k"), F.posexplode("r.tokens").alias("at", "token"))
    rarity = token.groupBy("token").agg(F.sum("docs").alias("df"))
    part = windows.select("window", "n", "k", F.size("tokens").alias("size"), F.posexplode("tokens").alias("offset", "token"))
    prefix = (
        part.join(rarity, "token")
        .groupBy("window", "n", "k", "size")
        .agg(F.count("*").alias("known"), F.min(F.struct("df", "token", "offset")).alias("rarest"))
        .where("known = size")
        .select("window", "n", "k", F.col("rarest.token").alias("token"), F.col("rarest.offset").alias("offset"))
    )
    met = token.join(prefix, ["token", "k"]).where("at >= offset").select("key", "run", "window", "n", F.expr("at - offset").alias("at"))
    words = run.select("key", "run", F.col("r.start").alias("first"), F.col("r.words").alias("words"))
    inside = met.join(words, ["key", "run"]).where("at + n <= size(words)")
    same = F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ") == F.col("window")
    return inside.where(same).select("key", F.expr("first + at").alias("start"), "n", "window").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, items, contaminated`` for every row of ``docs`` (``doc_id``, ``text``).

    ``items``: ids of the items of ``benchmark`` (``item_id``, ``text``) with a window in the document, sorted as strings.
    """
    from_items = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(_windows(window), _WINDOWS)
    from_items = stored(from_items, "windows")
    windows = from_items.dropDuplicates(["window"]).drop("item_id")
    items = from_items.select("window", "item_id").where("item_id IS NOT NULL").distinct()
    table = BitTable.of(from_items.select(F.explode("tokens").alias("token")))
    shortest = {r["k"]: r["n"] for r in from_items.groupBy("k").agg(F.min("n").alias("n")).collect()}  # k is 1 to SHINGLE

    scan = stored(docs.select("doc_id", "text").mapInArrow(_scan(table, shortest), _SCAN), "runs")
    runs = scan.where("key IS NOT NULL").groupBy("key").agg(F.first("runs").alias("runs"), F.count("*").alias("docs"))
    at = stored(_occurrences(stored(runs, "distinct-runs"), windows), "occurrences")

    # words covered by overlapping windows count once
    end, before = F.expr("start + n"), Window.partitionBy("key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    reach = at.select("key", "start", "n").distinct().withColumn("reach", F.max(end).over(before))
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce("reach", "start")))
    hit = reach.groupBy("key").agg(F.sum(fresh).cast("long").alias("n_hit"))
    named = at.select("key", "window").distinct().join(items, "window").groupBy("key").agg(
        F.array_sort(F.collect_set("item_id")).alias("items")
    )
    result = hit.join(named, "key", "left")
    none = F.lit(None).cast("array<string>")
    some = scan.where("key IS NOT NULL").select("doc_id", "n_words", "key").join(result, "key", "left").drop("key")
    clean = scan.where("key IS NULL").select("doc_id", "n_words", F.lit(None).cast("long").alias("n_hit"), none.alias("items"))
    out = some.unionByName(clean)
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
