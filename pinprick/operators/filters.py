"""Selections: conditions, regions, masks, sparse points, samples and chunks."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import check_columns, coordinates
from ..functions.binning import Bins
from ..functions.regions import Region
from .spatial import neighbor_counts


@dataclass(frozen=True)
class Selector:
    """``lower_bound < column < upper_bound``, strict at both ends; nothing if not active."""

    column: str
    activate: bool = True
    lower_bound: float = 0
    upper_bound: float = float("inf")

    @property
    def condition(self) -> str:
        return f"{self.lower_bound} < {self.column} < {self.upper_bound}" if self.activate else ""

    def predicate(self) -> Column | None:
        if not self.activate:
            return None
        upper = F.lit(True) if self.upper_bound == float("inf") else F.col(self.column) < self.upper_bound
        return (F.col(self.column) > self.lower_bound) & upper


def filter_condition(selectors: Sequence[Selector]) -> Column:
    """All active selectors at once; true if there is none."""
    return functools.reduce(lambda a, b: a & b, [p for s in selectors if (p := s.predicate()) is not None], F.lit(True))


def select_by_condition(df: DataFrame, condition: str | Column | Sequence[Selector]) -> DataFrame:
    """Rows where the condition holds: an SQL expression (``a < x < b`` is read as two comparisons), a column or selectors."""
    if isinstance(condition, str):
        return df.where(_chained(condition))
    return df.where(condition if isinstance(condition, Column) else filter_condition(condition))


def _chained(condition: str) -> str:
    import re

    side = r"[-+.\w`]+"
    return re.sub(rf"({side})\s*(<=|<|>=|>)\s*({side})\s*(<=|<|>=|>)\s*({side})", r"(\1 \2 \3 AND \3 \4 \5)", condition)


def select_by_region(df: DataFrame, region: Region, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows inside the region, a plain predicate; its box comes first and reaches the scan."""
    columns = check_columns(df.columns, columns)[: region.dimension]
    return df.where(region.contains([F.col(c) for c in columns]))


def select_by_image_mask(df: DataFrame, mask: DataFrame, bins: Bins, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose bin is in ``mask`` (bin numbers b0, b1, ... and a value that is not 0): a semi-join."""
    columns = check_columns(df.columns, columns)[: bins.dimension]
    marks = [f"_b{k}" for k in range(bins.dimension)]
    own = mask.where("value <> 0").select(*(F.col(f"b{k}").alias(m) for k, m in enumerate(marks)))
    return df.withColumns({m: bins.index(k, F.col(c)) for k, (m, c) in enumerate(zip(marks, columns))}).join(own, marks, "left_semi").drop(*marks)


def exclude_sparse_points(df: DataFrame, other: DataFrame | None = None, *, radius: float = 50, min_samples: int = 5, id_col: str = "index") -> DataFrame:
    """Rows with at least ``min_samples`` neighbours within ``radius``; in self mode the point is not its own neighbour."""
    counts = neighbor_counts(df, other, radii=[radius], id_col=id_col)
    return df.join(counts.where(F.col("n0") >= min_samples), id_col, "left_semi")


def random_subset(df: DataFrame, n: int, *, replace: bool = True, seed: int = 0, id_col: str = "index") -> DataFrame:
    """n rows drawn with (default) or without replacement, the same for any partitioning.

    Without: the rows of the n smallest hashes of seed and id. With: n draws of a row number,
    joined with the rows numbered in order of that hash.
    """
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    if not replace:
        return df.orderBy(h, id_col).limit(n)
    numbered = numbered_rows(df, [h, F.col(id_col)], "_row")
    total = df.count()
    draws = df.sparkSession.range(n).select(F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(max(total, 1))).alias("_row"))
    return numbered.join(draws, "_row").drop("_row")


def numbered_rows(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Row numbers from 0 in ``order``, without a single-task window: ranges are numbered apart and
    shifted by the rows of the ranges before (one number per partition)."""
    from .components import written

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = df.withColumns({f"_o{k}": c for k, c in enumerate(order)}).repartitionByRange(n, *(f"_o{k}" for k in range(len(order)))).withColumn("_p", F.spark_partition_id())
    part = written(part)
    sizes = {r["_p"]: r["count"] for r in part.groupBy("_p").count().collect()}
    starts, at = [], 0
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    offsets = df.sparkSession.createDataFrame(starts, "_p int, _start long")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*(f"_o{k}" for k in range(len(order)))))
    return part.withColumn(name, local - 1).join(F.broadcast(offsets), "_p").withColumn(name, F.col(name) + F.col("_start")).drop("_p", "_start", *(f"_o{k}" for k in range(len(order))))


def chunks(df: DataFrame, *, order_by: str, chunks: Sequence[Sequence[int]] | None = None, chunk_size: int | None = None, n_chunks: int | None = None, order: str = "successive", drop: bool = False) -> DataFrame:
    """Add ``chunk``: explicit lists of ids, or pieces of ``chunk_size`` rows, or ``n_chunks`` pieces.

    Successive pieces follow ``order_by``; alternating ones deal the rows in turn. If n_chunks does not
    divide n, successive pieces have n // (n_chunks - 1) rows and the last one the rest, which may be
    none. ``drop`` leaves out a last piece that is shorter than the others.
    """
    if sum(x is not None for x in (chunks, chunk_size, n_chunks)) != 1:
        raise ValueError("give one of chunks, chunk_size, n_chunks")
    if order not in ("successive", "alternating"):
        raise ValueError("order is successive or alternating")
    if chunks is not None:
        rows = [(int(i), k) for k, ids in enumerate(chunks) for i in ids]
        return df.join(df.sparkSession.createDataFrame(rows, f"{order_by} long, chunk int"), order_by)
    n = df.count()
    if n_chunks is not None:
        size = n // n_chunks if n_chunks == 1 or n % n_chunks == 0 else n // (n_chunks - 1)
        many = n_chunks
    else:
        size, many = chunk_size, -(-n // chunk_size)
    rows = numbered_rows(df, [F.col(order_by)], "_row")
    size = max(size, 1)
    rows = rows.withColumn("chunk", (F.floor(F.col("_row") / size) if order == "successive" else F.col("_row") % max(many, 1)).cast("int"))
    if drop and many > 1:
        last = rows.where(F.col("chunk") == many - 1).count()
        if last < (size if order == "successive" else -(-n // many)):
            rows = rows.where(F.col("chunk") < many - 1)
    return rows.drop("_row")


def localizations_in_regions(df: DataFrame, regions: dict[int, Region], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with the ``region_id`` of each region they lie in (once per region)."""
    columns = [F.col(c) for c in check_columns(df.columns, columns)]
    hits = F.array_compact(F.array(*(F.when(r.contains(columns[: r.dimension]), F.lit(int(k))) for k, r in regions.items())))
    return df.withColumn("region_id", F.explode(hits))


def rasterize(df: DataFrame, n_regions: Sequence[int], columns: Sequence[str] | None = None, bounds: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """Add ``tile_x`` and ``tile_y``: the support cut into n_regions rectangles, [lo, hi) each."""
    columns = check_columns(df.columns, columns)[:2]
    if bounds is None:
        r = df.agg(*(f(c) for c in columns for f in (F.min, F.max))).first()
        bounds = [(r[0], r[1]), (r[2], r[3])]
    out = df
    for c, axis, n, (lo, hi) in zip(columns, "xy", n_regions, bounds):
        out = out.withColumn(f"tile_{axis}", F.floor((F.col(c) - lo) / ((hi - lo) / n)).cast("int")).where((F.col(f"tile_{axis}") >= 0) & (F.col(f"tile_{axis}") < n))
    return out


def projection(df: DataFrame, labels: str | Sequence[str]) -> DataFrame:
    """The frame without the other coordinate columns."""
    keep = check_columns(df.columns, labels)
    return df.drop(*(c for c in coordinates(df.columns) if c not in keep))


def concat(frames: Sequence[DataFrame], id_col: str = "index") -> DataFrame:
    """Rows of all frames, matched by name, numbered from 0: frame after frame, each in the order of its ids (or of its rows, if it has none)."""
    from .components import written

    parts = [f.withColumns({"_frame": F.lit(k), "_id": F.col(id_col).cast("long") if id_col in f.columns else F.monotonically_increasing_id()}).drop(id_col) for k, f in enumerate(frames)]
    both = written(functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))
    return numbered_rows(both, [F.col("_frame"), F.col("_id")], id_col).drop("_frame", "_id")
