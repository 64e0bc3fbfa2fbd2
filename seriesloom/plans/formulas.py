"""Signals as formulas over base signals.

A virtual signal such as ``s["speed"] * 3.6`` or ``s["a"] + s["b"]`` is not computed when it is written down. It is a formula: the
base signals it needs and a column expression over their values. Formulas that need the same base signals, under the
same event, read the same rows, aligned once however many of them there are. What is not arithmetic (edges, masks,
integrals, ...) asks a formula for its frame and goes on as for any series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.align import overlaps
from seriesloom.operators.grid import TimeGrid
from seriesloom.operators.series import ID, Intervals, SampleSeries


def value_of(name: str) -> str:
    """The column with the values of a base signal."""
    return f"v_{name}"


class Sources:
    """Base signals by name, and the rows of any set of them.

    ``settle`` is given each frame that takes an alignment, with a name, and may write it and read it back.
    """

    def __init__(self, settle: Callable[[str, DataFrame], DataFrame] = lambda name, frame: frame) -> None:
        self.base: dict[str, SampleSeries] = {}
        self._settle = settle
        self._rows: dict[tuple, DataFrame] = {}

    @property
    def grid(self) -> TimeGrid:
        return next(iter(self.base.values())).grid

    def add(self, name: str, series: SampleSeries) -> Formula:
        for known in self.base.values():
            known._check_grid(series)
            break
        self.base[name] = series
        return Formula(self, frozenset([name]), F.col(value_of(name)))

    def rows(self, names: Iterable[str], cut: bool = False, event: tuple[str, Intervals] | None = None) -> DataFrame:
        """Stretches where all named signals (and the event) hold, with their values: ``v_<name>`` each.

        One signal without an event has its own runs; with ``cut``, those that have a length, as in an alignment.
        """
        names = sorted(names)
        key = (*names, cut, event and event[0])
        if key not in self._rows:
            frames = {value_of(n): self.base[n].frame for n in names}
            if event is None and len(names) == 1:
                runs = self.base[names[0]].frame.withColumnRenamed("value", value_of(names[0]))
                self._rows[key] = runs.where(F.col("tend") > F.col("tstart")) if cut else runs
            else:
                if event is not None:
                    frames["event"] = event[1].merge_overlaps().frame
                met = overlaps(frames, self.grid)
                values = [F.col(f"{value_of(n)}.value").alias(value_of(n)) for n in names]
                name = "-".join(["aligned", *names, *([event[0]] if event else [])])
                self._rows[key] = self._settle(name, met.select(ID, "tstart", "tend", *values))
        return self._rows[key]


class Formula(SampleSeries):
    """``value``: an expression over the values of the base signals ``names``; ``cut``: it is made of aligned stretches."""

    def __init__(self, sources: Sources, names: frozenset[str], value: Column, cut: bool = False) -> None:
        self.sources = sources
        self.names = names
        self.value = value
        self.cut = cut
        self.grid = sources.grid

    @property
    def support(self) -> tuple[tuple[str, ...], bool]:
        """Formulas of equal support read the same rows."""
        return tuple(sorted(self.names)), self.cut and len(self.names) == 1

    @property
    def frame(self) -> DataFrame:
        names, cut = self.support
        return self.sources.rows(names, cut).select(ID, "tstart", "tend", self.value.alias("value"))

    def rows(self, event: tuple[str, Intervals] | None = None) -> DataFrame:
        names, cut = self.support
        return self.sources.rows(names, cut and event is None, event)

    def _map(self, change: Callable[[Column], Column]) -> Formula:
        return Formula(self.sources, self.names, change(self.value), self.cut)

    def _shares(self, other: object) -> bool:
        return isinstance(other, Formula) and other.sources is self.sources

    def _combine(self, other, op: Callable[[Column, Column], Column]) -> SampleSeries:
        if self._shares(other):
            return Formula(self.sources, self.names | other.names, op(self.value, other.value), cut=True)
        return super()._combine(other, op)

    def _compare(self, other, op: Callable[[Column, Column], Column]) -> Intervals:
        if not self._shares(other):
            return super()._compare(other, op)
        rows = self.sources.rows(self.names | other.names, cut=len(self.names | other.names) == 1)
        holds = op(self.value, other.value) & ~F.isnan(self.value) & ~F.isnan(other.value)
        return Intervals(rows.where(holds), self.grid).merge_overlaps()

    __hash__ = object.__hash__


def by_support(formulas: Mapping[str, Formula]) -> dict[tuple, dict[str, Formula]]:
    """Formulas by what they read."""
    out: dict[tuple, dict[str, Formula]] = {}
    for name, f in formulas.items():
        out.setdefault(f.support, {})[name] = f
    return out
