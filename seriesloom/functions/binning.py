"""Histogram bins as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_edges(edges: Sequence[float]) -> list[float]:
    """Edges as floats; at least two, strictly rising."""
    out = [float(e) for e in edges]
    if len(out) < 2:
        raise ValueError("a histogram needs at least two bin edges")
    if any(not a < b for a, b in zip(out, out[1:])):
        raise ValueError("bin edges must be strictly rising")
    return out


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """Index of the bin holding the value: ``[lo, hi)``, the last bin closed; NULL outside the edges and for NaN.

    The edges become a balanced tree of comparisons, which stays inside generated code and needs log2(bins) steps.
    """
    edges = check_edges(edges)

    def descend(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(value < F.lit(edges[mid]), descend(lo, mid - 1)).otherwise(descend(mid, hi))

    inside = (value >= F.lit(edges[0])) & (value <= F.lit(edges[-1])) & ~F.isnan(value)
    return F.when(inside, descend(0, len(edges) - 2))


def with_bin(rows: DataFrame, out: str, value: Column, edges: str, most: int) -> DataFrame:
    """``rows`` with the index of the bin holding ``value`` among the edges in the row itself, by the rule of ``bin_index``.

    ``most`` is the largest number of edges of a row. One projection for each halving of the edges, all in generated code.
    """
    rows = rows.withColumn(out, F.lit(-1))
    for bit in reversed(range(most.bit_length())):
        ahead = F.col(out) + (1 << bit)
        rows = rows.withColumn(out, F.when(F.get(edges, ahead) <= value, ahead).otherwise(F.col(out)))
    last = F.size(edges) - 1
    inside = (value >= F.get(edges, F.lit(0))) & (value <= F.get(edges, last)) & ~F.isnan(value)
    return rows.withColumn(out, F.when(inside, F.least(out, last - 1)))


def edge_label(edge: float) -> str:
    return f"{edge:g}"


def bin_label(edges: Sequence[float], index: int) -> str:
    """Readable name of a bin, e.g. ``0 - 500``."""
    return f"{edge_label(edges[index])} - {edge_label(edges[index + 1])}"


def bin_table(edges: Sequence[float]) -> Column:
    """All bins as an array of (bin_id, lower_bound, upper_bound, bin_name), to be exploded."""
    edges = check_edges(edges)
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("bin_id"),
                F.lit(edges[i]).alias("lower_bound"),
                F.lit(edges[i + 1]).alias("upper_bound"),
                F.lit(bin_label(edges, i)).alias("bin_name"),
            )
            for i in range(len(edges) - 1)
        ]
    )
