"""Spatial statistics built on the radius join."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import coordinates
from ..functions.regions import Box
from .spatial import neighbor_counts, nearest_neighbors, radius_pairs


def ball(radius: float, dimension: int) -> float:
    """Length, area or volume of a ball."""
    return {1: 2 * radius, 2: math.pi * radius * radius, 3: 4 / 3 * math.pi * radius**3}[dimension]


def local_density(points: DataFrame, other: DataFrame | None = None, *, radii: Sequence[float], density: bool = True, boundary: Box | None = None, normalization: float | None = None, id_col: str = "index") -> DataFrame:
    """``local_density_<k>`` per radius: points around each point less one, over the ball's measure (in one dimension
    the radius) if ``density``, over the share of the ball that lies in ``boundary`` (a 2-D box), over ``normalization``.

    With another set the counts are of ``points`` around each of the others, one subtracted as well.
    """
    d = len(coordinates(points.columns))
    where = points if other is None else other
    less = 0 if other is None else 1
    counts = neighbor_counts(where, None if other is None else points, radii=radii, id_col=id_col)
    measure = [(r if d == 1 else ball(r, d)) if density else 1.0 for r in radii]
    out = counts.select(id_col, *(((F.col(f"n{k}") - less) / (m * (normalization or 1.0))).alias(f"local_density_{k}") for k, m in enumerate(measure)))
    if boundary is None:
        return out
    if d != 2:
        raise NotImplementedError("boundary correction is for two dimensions")
    x, y = coordinates(where.columns)
    share = where.select(id_col, *(_overlap(F.col(x), F.col(y), float(r), boundary).alias(f"_s{k}") for k, r in enumerate(radii)))
    return out.join(share, id_col).select(id_col, *((F.col(f"local_density_{k}") / F.col(f"_s{k}")).alias(f"local_density_{k}") for k in range(len(radii))))


def _overlap(x: Column, y: Column, radius: float, box: Box, steps: int = 200) -> Column:
    """Share of a disc that lies in a box: its strips at evenly spaced angles, each cut to the box."""
    (x0, x1), (y0, y1) = box.bounds
    total = F.lit(0.0)
    nodes = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: (k + 0.5) * math.pi / steps - math.pi / 2)
    strip = lambda t: F.when((x + radius * F.sin(t) >= x0) & (x + radius * F.sin(t) <= x1), F.greatest(F.lit(0.0), F.least(F.lit(y1), y + radius * F.cos(t)) - F.greatest(F.lit(y0), y - radius * F.cos(t))) * F.cos(t)).otherwise(0.0)
    area = F.aggregate(F.transform(nodes, strip), total, lambda acc, v: acc + v) * (radius * math.pi / steps)
    return area / (math.pi * radius * radius)


def ripley(points: DataFrame, other: DataFrame | None = None, *, radii: Sequence[float], region_measure: float = 1, id_col: str = "index") -> DataFrame:
    """(radius, ripley_k, ripley_l, ripley_h): K = A/(n(m-1)) times the sum over all m query points (the others, or
    the points themselves) of the n points around each, less one; L is the radius that K has in a uniform field, H = L - r.
    One join at the largest radius, then one row per radius."""
    d = len(coordinates(points.columns))
    less = 0 if other is None else 1
    counts = neighbor_counts(points if other is None else other, None if other is None else points, radii=radii, id_col=id_col)
    sums = counts.agg(F.count("*").alias("m"), *(F.sum(F.col(f"n{k}") - less).alias(f"s{k}") for k in range(len(radii))))
    # one row against one row
    n = sums.select(F.col("m").alias("n")) if other is None else points.agg(F.count("*").alias("n"))
    rows = sums.crossJoin(n).select("n", "m", F.explode(F.array(*(F.struct(F.lit(float(r)).alias("radius"), F.col(f"s{k}").alias("s")) for k, r in enumerate(radii)))).alias("r"))
    k = F.lit(float(region_measure)) / (F.col("n") * (F.col("m") - 1)) * F.col("r.s")
    out = rows.select(F.col("r.radius").alias("radius"), k.alias("ripley_k"))
    ell = {1: F.col("ripley_k") / 2, 2: F.sqrt(F.col("ripley_k") / math.pi), 3: F.cbrt(F.col("ripley_k") * (3 / 4) / math.pi)}[d]
    return out.withColumn("ripley_l", ell).withColumn("ripley_h", F.col("ripley_l") - F.col("radius"))


def ripley_h_maximum(table: DataFrame) -> DataFrame:
    """The radius at which H is largest (the smallest such), and H there."""
    best = F.max(F.struct("ripley_h", (-F.col("radius")).alias("r")))
    return table.agg(best.alias("m")).select((-F.col("m.r")).alias("radius"), F.col("m.ripley_h").alias("ripley_h"))


def radial_distribution(points: DataFrame, other: DataFrame | None = None, *, edges: Sequence[float], density: float, id_col: str = "index") -> DataFrame:
    """(radius, delta_radius, n, rdf) for bins of pair distance: 2 n / (points x density of the others x shell),
    the factor 2 in the cross case too. Distances come from the grid join at the last edge, so only near
    pairs are ever made; the last bin is closed on the right. Empty bins are listed."""
    d = len(coordinates(points.columns))
    spark = points.sparkSession
    pairs = radius_pairs(points, other, radius=edges[-1], id_col=id_col)
    if other is None:
        pairs = pairs.where("id1 < id2")
    last = len(edges) - 2
    number = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= F.col("distance"))) - 1
    counts = pairs.where(F.col("distance") >= edges[0]).groupBy(F.least(number, F.lit(last)).alias("bin")).agg(F.count("*").alias("n"))
    shell = [ball(b, d) / (2 if d == 1 else 1) - ball(a, d) / (2 if d == 1 else 1) for a, b in zip(edges, edges[1:])]
    table = spark.createDataFrame([(k, float(a), float(b - a), s) for k, (a, b, s) in enumerate(zip(edges, edges[1:], shell))], "bin int, radius double, delta_radius double, shell double")
    total = points.agg(F.count("*").alias("_total"))  # one row
    out = table.join(counts, "bin", "left").crossJoin(total).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.select("radius", "delta_radius", "n", (F.col("n") * 2 / (F.col("_total") * F.lit(float(density)) * F.col("shell"))).alias("rdf"))


def radial_distribution_batch(sets: Sequence[DataFrame], *, edges: Sequence[float], densities: Sequence[float]) -> DataFrame:
    """Long form over several sets: ``dataset_id`` and the columns of :func:`radial_distribution`; one plan."""
    out = None
    for k, (points, density) in enumerate(zip(sets, densities, strict=True)):
        own = radial_distribution(points, edges=edges, density=density).withColumn("dataset_id", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out


def colocalization(points: DataFrame, other: DataFrame | None = None, *, radius: float = 100, n_steps: int = 10, id_col: str = "index") -> DataFrame:
    """(id, cbc): rank correlation of the cumulative neighbour counts in ``n_steps`` rings of own and other points, each
    per ring area, times exp(-farthest other / radius); null without own or other neighbours.

    A point is not its own neighbour among the own points, but is (at distance 0) where no other set is given.
    Everything is array arithmetic on one row per point; constant counts (no rank order) give null.
    """
    def rings(p: DataFrame, name: str) -> DataFrame:
        step = F.least(F.floor(F.col("distance") / F.lit(radius / n_steps)), F.lit(n_steps - 1))
        return p.groupBy("id1").agg(*(F.count_if(step <= k).alias(f"{name}{k}") for k in range(n_steps)), F.max("distance").alias(f"{name}_far"))

    own = rings(radius_pairs(points, radius=radius, id_col=id_col), "a")
    mine = radius_pairs(points, points if other is None else other, radius=radius, id_col=id_col)
    both = own.join(rings(mine, "b"), "id1")
    out = both
    for side in "ab":
        # ranks need no common factors, and without them equal ratios are equal numbers
        values = [F.col(f"{side}{k}") / float((k + 1) ** 2) for k in range(n_steps)]
        out = out.withColumn(f"_{side}", F.array(*values))
        out = out.withColumn(f"_{side}", _ranks(f"_{side}"))
    mean = n_steps / 2
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: (u - mean) * (v - mean)), F.lit(0.0), lambda acc, v: acc + v)
    spread = F.sqrt(dot("_a", "_a") * dot("_b", "_b"))
    out = out.withColumn("cbc", F.when(spread > 0, dot("_a", "_b") / spread) * F.exp(-F.col("b_far") / radius))
    return points.select(id_col).join(out.select(F.col("id1").alias(id_col), "cbc"), id_col, "left")


def _ranks(name: str):
    """Average ranks of an array's values: those below, and half of those equal."""
    return F.transform(name, lambda v: F.aggregate(name, F.lit(0.0), lambda acc, w: acc + F.when(w < v, 1.0).when(w == v, 0.5).otherwise(0.0)))


def nearest_neighbor_distances(points: DataFrame, other: DataFrame | None = None, *, k: int = 1, id_col: str = "index") -> DataFrame:
    """(id, nn_distance, nn_index) to the k-th neighbour."""
    return nearest_neighbors(points, other, k=k, id_col=id_col).select(id_col, F.col("distance").alias("nn_distance"), F.col("neighbor").alias("nn_index"))


def fit_nearest_neighbor_csr(distances: DataFrame, dimension: int = 2, column: str = "nn_distance") -> DataFrame:
    """Density of a uniform random field that fits the distances best: n over the summed measures of their balls."""
    volume = {2: math.pi * F.col(column) * F.col(column), 3: 4 / 3 * math.pi * F.pow(column, F.lit(3))}[dimension]
    return distances.agg((1 / F.avg(volume)).alias("density"))

