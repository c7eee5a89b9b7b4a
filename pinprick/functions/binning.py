"""Bin specifications, as expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges_from_size(size: float | Sequence[float], lo: float, hi: float, extend: bool | None = None) -> list[float]:
    """Edges of bins of ``size`` from ``lo`` on. What is left over at the end is dropped
    (extend None), covered by one more whole bin (True) or by a shorter one (False). Where not even
    the first bin fits, there is one: that whole bin (True) or the range."""
    first = size if isinstance(size, (int, float)) else size[0]
    if first > hi - lo:
        return [lo, lo + first] if extend is True else [lo, hi]
    if isinstance(size, (int, float)):
        n = int(math.floor((hi - lo) / size + 1e-12))
        edges = [lo + k * size for k in range(n + 1)]
        more = size
    else:
        edges = [lo]
        for s in size:
            if edges[-1] + s > hi + 1e-12:
                break
            edges.append(edges[-1] + s)
        more = size[min(len(edges) - 1, len(size) - 1)]
    if edges[-1] < hi - 1e-12 * max(1, abs(hi)):
        if extend is True:
            edges.append(edges[-1] + more)
        elif extend is False:
            edges.append(hi)
    return edges


def edges_from_number(n: int, lo: float, hi: float) -> list[float]:
    return [lo + (hi - lo) * k / n for k in range(n)] + [hi]


@dataclass(frozen=True)
class Bins:
    """Edges for each axis; bins are [edge, next edge)."""

    edges: tuple[tuple[float, ...], ...]
    labels: tuple[str, ...] | None = None

    @staticmethod
    def of(*, n_bins: int | Sequence[int] | None = None, bin_size: float | Sequence | None = None, bin_edges: Sequence | None = None, bin_range: Sequence | None = None, labels: Sequence[str] | None = None, extend_range: bool | None = None) -> "Bins":
        """From exactly one of number, size or edges; a scalar holds for every axis."""
        if sum(x is not None for x in (n_bins, bin_size, bin_edges)) != 1:
            raise ValueError("give one of n_bins, bin_size, bin_edges")
        if bin_edges is not None:
            nested = bin_edges if isinstance(bin_edges[0], (list, tuple)) else [bin_edges]
            return Bins(tuple(tuple(map(float, e)) for e in nested), tuple(labels) if labels else None)
        if bin_range is None:
            raise ValueError("bin_range is needed; Bins.over takes it from the data")
        ranges = list(bin_range) if isinstance(bin_range[0], (list, tuple)) else [tuple(bin_range)]
        what = n_bins if n_bins is not None else bin_size
        each = list(what) if isinstance(what, (list, tuple)) else [what] * len(ranges)
        if len(each) != len(ranges):
            raise ValueError("as many sizes as ranges are needed")
        make = (lambda w, r: edges_from_number(int(w), *r)) if n_bins is not None else (lambda w, r: edges_from_size(w, *r, extend_range))
        return Bins(tuple(tuple(make(w, (float(r[0]), float(r[1])))) for w, r in zip(each, ranges)), tuple(labels) if labels else None)

    @staticmethod
    def over(df: DataFrame, columns: Sequence[str], special: str | None = None, **options) -> "Bins":
        """Bins over the data's own ranges: one row of minima and maxima; ``special`` as for ranges ('zero' or 'link')."""
        from ..operators.properties import ranges

        row = ranges(df, list(columns), special).first()
        return Bins.of(bin_range=[(row[f"{c}_min"], row[f"{c}_max"]) for c in columns], **options)

    @property
    def dimension(self) -> int:
        return len(self.edges)

    @property
    def n_bins(self) -> tuple[int, ...]:
        return tuple(len(e) - 1 for e in self.edges)

    @property
    def bin_range(self) -> tuple[tuple[float, float], ...]:
        return tuple((e[0], e[-1]) for e in self.edges)

    @property
    def bin_size(self) -> tuple[tuple[float, ...], ...]:
        return tuple(tuple(b - a for a, b in zip(e, e[1:])) for e in self.edges)

    @property
    def bin_centers(self) -> tuple[tuple[float, ...], ...]:
        return tuple(tuple((a + b) / 2 for a, b in zip(e, e[1:])) for e in self.edges)

    @property
    def is_equally_sized(self) -> tuple[bool, ...]:
        return tuple(max(s) - min(s) <= 1e-9 * max(map(abs, s)) for s in self.bin_size)

    def equalize_bin_size(self) -> "Bins":
        """Each axis with its first width throughout, within its range."""
        return Bins(tuple(tuple(edges_from_size(s[0], *r)) for s, r in zip(self.bin_size, self.bin_range)), self.labels)

    def index(self, axis: int, x: Column) -> Column:
        """Bin number from 0; null outside the range."""
        at = self.digitized(axis, x) - 1
        return F.when((at >= 0) & (at < self.n_bins[axis]), at)

    def digitized(self, axis: int, x: Column) -> Column:
        """0 below the range, 1 to n inside, n + 1 (the last edge included) above."""
        e, n = self.edges[axis], self.n_bins[axis]
        if self.is_equally_sized[axis]:
            guess = F.floor((x - F.lit(e[0])) / F.lit((e[-1] - e[0]) / n)).cast("int")
            return F.when(x.isNull(), None).when(x < e[0], 0).when(x >= e[-1], n + 1).otherwise(F.least(guess, F.lit(n - 1)) + 1)
        return F.when(x.isNotNull(), F.size(F.filter(F.array(*(F.lit(v) for v in e)), lambda v: v <= x)))

    def center(self, axis: int, index: Column) -> Column:
        return F.get(F.array(*(F.lit(c) for c in self.bin_centers[axis])), index)
