"""Fill-in-the-middle: a text is cut at two ranks of its units and its parts are put in another order around markers.

Units are runs of ASCII letters and single other code points. An indexable skip list stands over the units of a text: the
lowest lane has one link per unit, each lane above keeps about every ``2 ** STEP``-th node of the one below, chosen by a hash of
the node's place. A link carries two widths, the units and the code points that it passes, and the widths of an express link
are the sums of those that it spans. A cut rank is reached by descending from the highest lane: go along while the
accumulated unit width stays at or below the rank, else go down; the accumulated code-point width is then the cut, exactly.

The ranks and the form of a document come from a hash of its id alone, so a document is cut alike in every run and on every
executor. Texts are handled in their task, whole, at about twenty bytes a code point.

A null text is an empty text, and an empty text stays plain with no units. A null id is hashed as no digits. Repeated rows
give equal rows. Texts that hold a marker stay plain, so that ``restored`` is exact. Other columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.shingles import A, mix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A lane keeps about one in 2 ** STEP nodes of the lane below; lanes end where a lane would have so few nodes.
STEP, TOP = 4, 8
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_starts(text: str) -> np.ndarray:
    """The place (code point) at which each unit of ``text`` begins."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((c | 32) >= 97) & ((c | 32) <= 122) & (c < 128)
    goes_on = np.zeros(len(c), bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    return np.flatnonzero(~goes_on)


class SkipList:
    """Lanes over units of given widths. ``cut(rank)`` gives the code points that the first ``rank`` units take."""

    def __init__(self, widths: np.ndarray) -> None:
        #: Lowest lane first; each is (place of its nodes in the lane below, units and code points passed by each link)
        self.lanes = [(np.arange(len(widths)), np.ones(len(widths), np.int64), widths.astype(np.int64))]
        height = mix(np.arange(1, len(widths) + 1, dtype=np.uint64) * A)
        while len(height) > TOP:
            stays = (height & np.uint64((1 << STEP) - 1)) == 0
            stays[0] = True  # the head of every lane
            at = np.flatnonzero(stays)
            if len(at) == len(height):
                break
            _, units, chars = self.lanes[-1]
            self.lanes.append((at, np.add.reduceat(units, at), np.add.reduceat(chars, at)))
            height = height[at] >> np.uint64(STEP)

    def cut(self, rank: int) -> int:
        node, units, chars = 0, 0, 0
        for level in range(len(self.lanes) - 1, -1, -1):
            below, unit_width, char_width = self.lanes[level]
            while node < len(below) and units + unit_width[node] <= rank:
                units += int(unit_width[node])
                chars += int(char_width[node])
                node += 1
            if level:  # down: the same node of the lane below, or its end
                node = int(below[node]) if node < len(below) else len(self.lanes[level - 1][0])
        return chars


def draws(seed: str, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the hash of ``seed:doc_id``."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def transform(text: str, draw: tuple[int, int, int, int], changed: int, suffix_first: int):
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    starts = unit_starts(text)
    n = len(starts)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or draw[2] % 100 >= changed:
        return n, "plain", None, None, text
    lanes = SkipList(np.diff(np.append(starts, len(text))))
    a, b = (lanes.cut(rank) for rank in sorted((draw[0] % (n + 1), draw[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draw[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _run(seed: str, changed: int, suffix_first: int) -> Callable:
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            for part in _parts(texts):
                rows = [transform(t or "", draws(seed, ids[at + i]), changed, suffix_first) for i, t in enumerate(part)]
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )
                at += len(part)

    return run


def _parts(texts: pa.Array, size: int = 1 << 24):
    """The texts in order, about ``size`` bytes at a time, so that a batch of long ones is not held several times over."""
    ends = np.cumsum(np.array([len(t) if t else 0 for t in (x.as_buffer() for x in texts.cast(pa.binary()))], np.int64))
    at = 0
    while at < len(texts):
        until = max(at + 1, bisect_right(ends, (ends[at - 1] if at else 0) + size))
        yield texts.slice(at, until - at).to_pylist()
        at = until


def fill_in_middle(docs: DataFrame, seed: str = "1", changed: int = 90, suffix_first: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs`` (``doc_id`` long, ``text``).

    ``changed`` percent of the documents are transformed, ``suffix_first`` percent of these with the suffix first
    (``spm``), the others with the prefix first (``psm``); the rest is ``plain``.
    """
    return docs.select("doc_id", "text").mapInArrow(_run(seed, changed, suffix_first), _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form: no part holds a marker, so the markers' places are sure."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
