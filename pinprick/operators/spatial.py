"""Distance joins as equi-joins on grid cells.

A radius join never plans as a nested loop: one side goes to its cell of an edge a little over r, the other
to the 3^d cells around its own, cells meet by equality and the exact distance decides. Cells
spread over the partitions by hash; a dense cell is a skewed key of a plain join, which
adaptive execution splits.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import coordinates
from .components import written


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Euclidean distance, summed in order of axis."""
    total = None
    for x, y in zip(a, b, strict=True):
        d = (x - y) * (x - y)
        total = d if total is None else total + d
    return F.sqrt(total)


def _side(df: DataFrame, id_col: str, coords: list[str], mark: str) -> DataFrame:
    return df.select(F.col(id_col).alias(f"id{mark}"), *(F.col(c).cast("double").alias(f"{c}{mark}") for c in coords)).dropna(subset=[f"{c}{mark}" for c in coords])


def radius_pairs(points: DataFrame, other: DataFrame | None = None, *, radius: float, id_col: str = "index", coords: list[str] | None = None, on: Sequence[str] = ()) -> DataFrame:
    """(id1, id2, distance) of all pairs with distance <= ``radius``, each from ``points`` to ``other``.

    Without ``other`` the points are joined with themselves, pairs of one id left out, both
    directions kept. Rows with a null coordinate match nothing. ``on`` adds equality columns
    (common to both sides), which must match too.
    """
    if radius <= 0 or not math.isfinite(radius):
        raise ValueError("radius is a positive number")
    coords = coords or coordinates(points.columns)
    target = points if other is None else other
    a = _side(points, id_col, coords, "1") if not on else _with(points, id_col, coords, "1", on)
    b = _side(target, id_col, coords, "2") if not on else _with(target, id_col, coords, "2", on)
    edge = float(radius) * 1.001  # so that rounding cannot put two points at the radius two cells apart
    cell = lambda c: F.floor(F.col(c) / F.lit(edge)).cast("long")
    for k, c in enumerate(coords):
        a = a.withColumn(f"_g{k}", cell(f"{c}1"))
        b = b.withColumn(f"_g{k}", cell(f"{c}2"))
    steps = F.array(*(F.struct(*(F.lit(s).alias(f"s{k}") for k, s in enumerate(step))) for step in itertools.product((-1, 0, 1), repeat=len(coords))))
    b = b.withColumn("_s", F.explode(steps))
    for k in range(len(coords)):
        b = b.withColumn(f"_g{k}", F.col(f"_g{k}") + F.col(f"_s.s{k}"))
    keys = [f"_g{k}" for k in range(len(coords))] + [f"_on{k}" for k in range(len(on))]
    d = distance([F.col(f"{c}1") for c in coords], [F.col(f"{c}2") for c in coords])
    pairs = a.join(b.drop("_s"), keys).withColumn("distance", d).where(F.col("distance") <= radius)
    return (pairs.where("id1 <> id2") if other is None else pairs).select("id1", "id2", "distance")


def _with(df: DataFrame, id_col: str, coords: list[str], mark: str, on: Sequence[str]) -> DataFrame:
    side = df.select(F.col(id_col).alias(f"id{mark}"), *(F.col(c).cast("double").alias(f"{c}{mark}") for c in coords), *(F.col(c).alias(f"_on{k}") for k, c in enumerate(on)))
    return side.dropna(subset=[f"{c}{mark}" for c in coords])


def neighbor_counts(points: DataFrame, other: DataFrame | None = None, *, radii: Sequence[float], id_col: str = "index", coords: list[str] | None = None) -> DataFrame:
    """Per point the number of neighbours within each radius, as n0, n1, ...: one join at the
    largest radius, zero counts kept. In self mode the point itself is not counted."""
    pairs = radius_pairs(points, other, radius=max(radii), id_col=id_col, coords=coords)
    counts = pairs.groupBy("id1").agg(*(F.count_if(F.col("distance") <= float(r)).alias(f"n{k}") for k, r in enumerate(radii)))
    out = points.select(F.col(id_col)).join(counts, F.col(id_col) == F.col("id1"), "left").drop("id1")
    return out.select(id_col, *(F.coalesce(f"n{k}", F.lit(0).cast("long")).alias(f"n{k}") for k in range(len(radii))))


#: Candidate pairs of a first search for each row and neighbour, about; more are avoided by a smaller radius.
CROWD = 16
#: Candidate pairs that a last search over everything may always have.
JUMP = 5_000_000


def _first_search(points: DataFrame, target: DataFrame, same: bool, coords: list[str], id_col: str, k: int, radius: float, rows: int) -> tuple[float, DataFrame]:
    """A radius at which cells hold few candidates however uneven the density is, and the targets that can be among the k nearest.

    The radius shrinks until rows do not meet too many targets in their own cell. Where the smallest does not help, many
    targets share a place; of those only the k + 1 with the smallest ids can be among the k nearest of any row."""

    def load(edge: float) -> int:
        cells = [F.floor(F.col(c).cast("double") / F.lit(edge)).alias(f"_g{i}") for i, c in enumerate(coords)]
        held = target.groupBy(*cells).agg(F.count("*").alias("t"))
        if same:
            pairs = held.select((F.col("t") * F.col("t")).cast("decimal(38,0)").alias("v"))
        else:
            asked = points.groupBy(*cells).agg(F.count("*").alias("p"))
            pairs = held.join(asked, [f"_g{i}" for i in range(len(coords))]).select((F.col("t") * F.col("p")).cast("decimal(38,0)").alias("v"))
        return int(pairs.agg(F.sum("v")).first()[0] or 0)

    limit, steps = CROWD * k * rows, 20
    if load(radius) <= limit:
        return radius, target
    if load(radius / 4**steps) > limit:
        place = Window.partitionBy(*coords).orderBy(id_col)
        target = written(target.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= k + 1).drop("_place"))
        same = False
    wide, small = 0, steps  # the load falls with the radius: halve the interval of exponents
    while small - wide > 1:
        mid = (wide + small) // 2
        wide, small = (wide, mid) if load(radius / 4**mid) <= limit else (mid, small)
    return radius / 4**small, target


def nearest_neighbors(points: DataFrame, other: DataFrame | None = None, *, k: int = 1, id_col: str = "index", coords: list[str] | None = None, keep_all: bool = False) -> DataFrame:
    """(id, neighbor, distance, rank) of the k-th nearest neighbour of each point (or of the first k).

    Exact: all points within a radius are searched, and points with fewer than k hits search
    again within a larger one, up to the size of the box around everything. The first radius follows the densest places, so
    a search meets about k candidates for each point, and points left for a wider one are so far apart that they stay few in any cell.
    Ties go to the smaller id. A self search leaves the point itself out; points with fewer than k others have no row of rank k.
    """
    coords = coords or coordinates(points.columns)
    target = points if other is None else other
    box = target.agg(F.count("*").alias("n"), *(F.min(c).alias(f"lo{i}") for i, c in enumerate(coords)), *(F.max(c).alias(f"hi{i}") for i, c in enumerate(coords))).first()
    mine = points.agg(F.count("*").alias("n"), *(F.min(c).alias(f"lo{i}") for i, c in enumerate(coords)), *(F.max(c).alias(f"hi{i}") for i, c in enumerate(coords))).first()
    result_schema = "id1 long, id2 long, distance double, rank int"
    if not box["n"] or box["lo0"] is None or mine["lo0"] is None:
        return points.sparkSession.createDataFrame([], result_schema).withColumnsRenamed({"id1": id_col, "id2": "neighbor"})
    wide = [max(box[f"hi{i}"], mine[f"hi{i}"]) - min(box[f"lo{i}"], mine[f"lo{i}"]) for i in range(len(coords))]
    spans = [max(box[f"hi{i}"] - box[f"lo{i}"], 1e-12) for i in range(len(coords))]
    reach = math.sqrt(sum(x * x for x in wide)) * (1 + 1e-9) + 1e-12
    radius = min(1.5 * (k * math.prod(spans) / box["n"]) ** (1 / len(coords)), reach)
    columns = dict.fromkeys([id_col, *coords])
    radius, target = _first_search(points.select(*columns).dropna(subset=coords), target.select(*columns).dropna(subset=coords), other is None, coords, id_col, k, radius, max(mine["n"], box["n"]))
    order = Window.partitionBy("id1").orderBy("distance", "id2")
    left, found = points.dropna(subset=coords), None
    while True:
        near = radius_pairs(left, target, radius=radius, id_col=id_col, coords=coords)
        if other is None:
            near = near.where("id1 <> id2")
        if k == 1:  # a minimum needs no sorting
            near = near.groupBy("id1").agg(F.min(F.struct("distance", "id2")).alias("m")).select("id1", "m.id2", "m.distance", F.lit(1).alias("rank"), F.lit(1).alias("_n"))
        else:
            near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("_n", F.count("*").over(Window.partitionBy("id1")))
        last = radius >= reach
        part = near if last else written(near.where(F.col("_n") >= k))
        found = part if found is None else found.unionByName(part)
        if last:
            break
        left = written(left.join(part.select(F.col("id1").alias(id_col)).distinct(), id_col, "left_anti"))
        rest = left.count()
        if not rest:
            break
        few = rest * box["n"] <= max(JUMP, CROWD * k * max(mine["n"], box["n"]))
        radius = reach if few else min(2 * radius, reach)
    out = found if keep_all else found.where(F.col("rank") == k)
    return out.select(F.col("id1").alias(id_col), F.col("id2").alias("neighbor"), "distance", "rank")


#: Points of a block, and of each side of a task.
BLOCK, SIDE = 512, 4000


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each BLOCK points, with the id of the last."""
    for batch in batches:
        for i in range(0, len(batch), BLOCK):
            part = batch.slice(i, BLOCK)
            points = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.StructArray.from_arrays(part.columns, names=part.schema.names))
            yield pa.RecordBatch.from_arrays([part.column(0)[-1:], points], names=["last", "points"])


def _shares(side: DataFrame) -> int:
    n = side.count()
    return max(1, -(-n // SIDE), min(8, -(-n // BLOCK)))


def pair_distances(points: DataFrame, other: DataFrame | None = None, *, id_col: str = "index", coords: list[str] | None = None) -> DataFrame:
    """(id1, id2, pair_distance) of all unordered pairs, or of all cross pairs: the result itself is quadratic.

    Both sides are dealt evenly, whatever files they come from, so that a task joins about SIDE points with as many;
    one side comes in blocks that are opened after the join. Without ``other``, blocks hold neighbouring ids, and
    those with no larger id are left out as a whole.
    """
    coords = coords or coordinates(points.columns)
    a, b = _side(points, id_col, coords, "1"), _side(points if other is None else other, id_col, coords, "2")
    n = _shares(a)
    m = n if other is None else _shares(b)
    ordered = b if other is not None else b.repartitionByRange(m, *b.columns).sortWithinPartitions("id2")
    kinds = T.StructType([T.StructField("last", b.schema["id2"].dataType), T.StructField("points", T.ArrayType(b.schema))])
    blocks, a = ordered.mapInArrow(_blocks, kinds).repartition(m).hint("shuffle_replicate_nl"), a.repartition(n)
    both = blocks.join(a, F.col("id1") < F.col("last")) if other is None else blocks.crossJoin(a)
    both = both.select(*a.columns, F.inline("points"))
    both = both.where("id1 < id2") if other is None else both
    return both.select("id1", "id2", distance([F.col(f"{c}1") for c in coords], [F.col(f"{c}2") for c in coords]).alias("pair_distance"))
