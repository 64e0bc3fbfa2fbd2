"""Best-fit decreasing packing of documents into token sequences.

Which bin a piece goes to depends on lengths alone, and there are at most ``capacity`` different lengths. So pieces are
counted by length, the packing is planned on the counts, and each piece finds its place from its number among the pieces
of its length. The plan is that of best-fit decreasing on all pieces one after another: pieces of one length fill the
tightest open bins first, and bins with equal room change together. A segment tree over remaining capacities names the
tightest room in logarithmic time. The driver sees one count per length and the plan, whose size depends on the capacity,
not on the number of documents.

A document is its token ids and the end token 0. Null text is empty text: one end token. Only documents longer than the
capacity are cut; the first piece takes the remainder. Repeated rows are packed each. A null id is carried along. Other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.tables import stored
from seriesloom.llm.token_ids import encoder

CAPACITY = 2048
#: The end token, id 0, as the bytes of an unsigned 32-bit integer.
END = bytes(4)
#: Texts encoded at once.
BATCH = 512
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long, ids array<int>"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens."""
    if n <= capacity:
        return [n]
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def _pieces(path: str | None, capacity: int, keep_ids: bool) -> Callable:
    """(doc_id, text) to pieces. ``part`` and ``nth`` number the pieces of one length within the task."""

    def run(batches):
        encode = encoder(path or tokenizer_file())
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low in range(0, len(texts), BATCH):
                rows = []
                for i, ids in enumerate(encode([t or "" for t in texts[low : low + BATCH]])):
                    ids += END
                    start = 0
                    for piece, n in enumerate(cuts(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + n)]
                        rows.append((low + i, piece, start, n, zlib.crc32(own), int(seen[n]), own))
                        seen[n] += 1
                        start += n
                at, piece, start, length, crc, nth, own = zip(*rows, strict=True)
                ids = pa.array([np.frombuffer(x, "<i4") for x in own] if keep_ids else [None] * len(own), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array([part] * len(at), pa.int32()),
                        pa.array(nth, pa.int64()),
                        ids,
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"],
                )

    return run


class Room:
    """A segment tree over remaining capacities: which have open bins, and the tightest that fits."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, bins: tuple[int, int]) -> None:
        """Add the bins numbered from bins[0] to before bins[1]."""
        if bins[0] < bins[1]:
            self.bins[room].append(bins)
            self._mark(room, True)

    def take(self, room: int) -> tuple[int, int]:
        bins = self.bins[room].pop()
        if not self.bins[room]:
            self._mark(room, False)
        return bins

    def _mark(self, room: int, value: bool) -> None:
        i = self.size + room
        self.open[i] = value
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest room of at least ``length`` that has an open bin."""
        i = self.size + length
        if self.open[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on counts by length: ``(length, first, last, bin, each, offset)``.

    Of the pieces of ``length``, number i from first to before last goes to bin + (i - first) // each, at
    offset + (i - first) % each * length.
    """
    room, bins, runs = Room(capacity), 0, []
    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        while done < total:
            left = room.tightest(length)
            if left is None:
                left, each = capacity, capacity // length
                new = -(-(total - done) // each)
                low, high = bins, bins + new
                bins += new
            else:
                each = left // length
                low, high = room.take(left)
            full = min(high - low, (total - done) // each)
            if full:
                runs.append((length, done, done + full * each, low, each, capacity - left))
                room.put(left - each * length, (low, low + full))
                done, low = done + full * each, low + full
            if done < total and low < high:  # fewer than would fill one bin
                rest = total - done
                runs.append((length, done, total, low, rest, capacity - left))
                room.put(left - rest * length, (low, low + 1))
                done, low = total, low + 1
            room.put(left, (low, high))
    return runs


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece of ``docs`` (``doc_id``, ``text``).

    ``keep_ids`` adds the column ``ids``, from which ``sequences`` builds the packed rows. ``tokenizer``: path of a
    tokenizer file that every executor can read; by default that of the installed package of public tokenizers.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, keep_ids), _PIECES)
    pieces = stored(rows, "pieces")  # part and nth hold for the written rows, whatever is computed again
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(
        plan(counts, capacity), "length long, first long, last long, bin long, each long, at long"
    )
    by_length = runs.groupBy("length").agg(
        F.array_sort(F.collect_list(F.struct("first", "last", "bin", "each", "at"))).alias("runs")
    )
    i, run = F.col("i"), F.col("run")
    return (
        pieces.join(first, ["length", "part"])
        .withColumn("i", F.col("before") + F.col("nth"))
        .join(F.broadcast(by_length), "length")  # one row per length, at most ``capacity`` of them
        .withColumn("run", F.get(F.filter("runs", lambda r: (r["first"] <= i) & (i < r["last"])), F.lit(0)))
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (run["bin"] + F.floor((i - run["first"]) / run["each"])).cast("long").alias("sequence_id"),
            (run["at"] + (i - run["first"]) % run["each"] * F.col("length")).cast("long").alias("offset"),
            *(["ids"] if keep_ids else []),
        )
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` from pieces with ids: one row of at most ``capacity`` tokens per sequence."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
