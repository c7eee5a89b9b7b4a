"""Hulls of groups of points: numpy within Arrow-fed group maps.

A hull needs few points of many: each partition first reduces every group to the hull of its own
rows, so a group of any size meets in one task as hull vertices only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import check_columns
from .components import components


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull, counter-clockwise from the lowest x; fewer than three distinct points as they are."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points: np.ndarray) -> list:
        out: list = []
        for q in points.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def area_of(v: np.ndarray) -> float:
    return abs(float(np.sum(v[:, 0] * np.roll(v[:, 1], -1) - np.roll(v[:, 0], -1) * v[:, 1]) / 2)) if len(v) > 2 else 0.0


def perimeter_of(v: np.ndarray) -> float:
    return float(np.sqrt(((v - np.roll(v, -1, 0)) ** 2).sum(1)).sum()) if len(v) > 2 else 0.0


def diameter_of(v: np.ndarray) -> float:
    return float(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)).max()) if len(v) else 0.0


def rectangle_of(v: np.ndarray) -> tuple[float, float, float]:
    """(length, width, angle in degrees) of the smallest rectangle around a convex polygon: one side lies on an edge."""
    if len(v) < 3:
        return (diameter_of(v), 0.0, 0.0)
    best = None
    for e in np.roll(v, -1, 0) - v:
        a = np.arctan2(e[1], e[0])
        r = v @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        w = np.ptp(r, axis=0)
        if best is None or w[0] * w[1] < best[0] - 1e-12:
            best = (w[0] * w[1], w[0], w[1], np.degrees(a))
    _, x, y, a = best
    if y > x:
        x, y, a = y, x, a + 90
    return float(x), float(y), float((a + 90) % 180 - 90)


def hull_vertices(df: DataFrame, by: str, coords: Sequence[str] | None = None) -> DataFrame:
    """(by, x, y): hull vertices of every group, those of each partition only: the rows that later steps need."""
    x, y = check_columns(df.columns, coords)[:2]
    rows = df.select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for key, g in b.groupby(by, sort=False):
                now = g[["x", "y"]].to_numpy()
                held[key] = convex_hull(np.concatenate([held[key], now]) if key in held else now)
        for key, v in held.items():
            yield pd.DataFrame({by: [key] * len(v), "x": v[:, 0], "y": v[:, 1]})

    return rows.mapInPandas(reduce, rows.schema)


def convex_hulls(df: DataFrame, by: str = "cluster_label", coords: Sequence[str] | None = None) -> DataFrame:
    """One row per group: area, perimeter, number of vertices, diameter, the smallest rectangle's sides, angle and ratio, density."""
    n = df.dropna(subset=check_columns(df.columns, coords)[:2]).groupBy(by).agg(F.count("*").alias("localization_count"))
    kind = dict(df.dtypes)[by]

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        v = convex_hull(pdf[["x", "y"]].to_numpy())
        a, b, angle = rectangle_of(v)
        return pd.DataFrame([[pdf[by].iloc[0], area_of(v), perimeter_of(v), len(v) if len(v) > 2 else 0, diameter_of(v), a, b, angle, b / a if a else 0.0]], columns=[by, "region_measure_ch", "subregion_measure_ch", "n_vertices_ch", "max_distance", "length_obb", "width_obb", "orientation_obb", "circularity_obb"])

    out = hull_vertices(df, by, coords).groupBy(by).applyInPandas(measure, f"`{by}` {kind}, region_measure_ch double, subregion_measure_ch double, n_vertices_ch long, max_distance double, length_obb double, width_obb double, orientation_obb double, circularity_obb double")
    out = out.join(n, by).withColumn("region_measure_obb", F.col("length_obb") * F.col("width_obb"))
    return out.withColumn("localization_density_ch", F.when(F.col("region_measure_ch") > 0, F.col("localization_count") / F.col("region_measure_ch")))


def delaunay(p: np.ndarray) -> np.ndarray:
    """Triangles (row numbers) of the Delaunay triangulation of distinct points, added one by one from left to right.

    A triangle whose circle ends left of the point is final and is not looked at again, so a point meets only the triangles along the front."""
    n = len(p)
    if n < 3:
        return np.zeros((0, 3), int)
    mid, span = p.mean(0), max(np.ptp(p, axis=0).max(), 1e-9) * 1e4
    q = np.vstack([p, mid + [-span, -span], mid + [span, -span], mid + [0, span]])
    tri = np.array([[n, n + 1, n + 2]])
    center, r2 = _circles(q, tri)
    final, looked = [], 0
    for i in np.argsort(p[:, 0], kind="stable"):
        if len(tri) > 2 * looked + 64:
            past = q[i, 0] - center[:, 0]
            past = (past > 0) & (past * past > r2 * (1 + 1e-9))
            final.append(tri[past])
            tri, center, r2 = tri[~past], center[~past], r2[~past]
            looked = len(tri)
        bad = ((center - q[i]) ** 2).sum(1) < r2 * (1 + 1e-12)
        edges = np.sort(np.concatenate([tri[bad][:, [0, 1]], tri[bad][:, [1, 2]], tri[bad][:, [2, 0]]]), axis=1)
        edges, times = np.unique(edges, axis=0, return_counts=True)
        rim = edges[times == 1]
        new = np.column_stack([rim, np.full(len(rim), i)])
        a, b = q[new[:, 1]] - q[new[:, 0]], q[new[:, 2]] - q[new[:, 0]]
        new = new[np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) > 0]
        c, r = _circles(q, new)
        tri, center, r2 = np.vstack([tri[~bad], new]), np.vstack([center[~bad], c]), np.append(r2[~bad], r)
    tri = np.vstack([*final, tri])
    return tri[(tri < n).all(1)]


def _circles(q: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c = q[tri[:, 0]], q[tri[:, 1]], q[tri[:, 2]]
    u, v = b - a, c - a
    d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    d = np.where(d == 0, 1e-300, d)
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    o = np.column_stack([v[:, 1] * uu - u[:, 1] * vv, u[:, 0] * vv - v[:, 0] * uu]) / d[:, None]
    return a + o, (o * o).sum(1)


def simplices_of(p: np.ndarray) -> tuple[list, list]:
    """Edges (i, j, a, b, c, enter, leave) and triangles (i, j, k, a, b, c) of the Delaunay triangulation.

    An edge belongs to the complex from half its length (a), is regular from the smaller circumradius beside it (b) and
    interior from the larger one (c; endless at the hull). A triangle's values are the largest of its edges.
    Between ``enter`` and ``leave`` an edge has exactly one triangle of the complex beside it."""
    tri = delaunay(p)
    if not len(tri):
        return [], []
    radius = np.sqrt(_circles(p, tri)[1])
    sides: dict[tuple[int, int], list[int]] = {}
    for n, t in enumerate(tri.tolist()):
        for k in range(3):
            sides.setdefault(tuple(sorted((t[k], t[(k + 1) % 3]))), []).append(n)
    of_edge = {}
    largest = np.zeros((len(tri), 3))
    for (i, j), around in sides.items():
        rs = sorted(float(radius[n]) for n in around) + [float("inf")]
        of_edge[i, j] = (float(np.sqrt(((p[i] - p[j]) ** 2).sum()) / 2), rs[0], rs[1])
        for n in around:
            largest[n] = np.maximum(largest[n], of_edge[i, j])
    edges = []
    for (i, j), around in sides.items():
        enters = sorted(float(largest[n, 0]) for n in around) + [float("inf")]
        edges.append((i, j, *of_edge[i, j], enters[0], enters[1]))
    return edges, [(*t, *v) for t, v in zip(tri.tolist(), largest.tolist())]


def alpha_complex(df: DataFrame, by: str = "cluster_label", coords: Sequence[str] | None = None) -> DataFrame:
    """Simplices of every group in one table: kind ('edge' or 'triangle'), end points, length or area, the alphas at which
    they enter (``a``), become regular (``b``) and interior (``c``), and between which an edge bounds the region
    (``enter``, ``leave``; null for triangles). One table answers any alpha by a filter."""
    x, y = check_columns(df.columns, coords)[:2]
    rows = df.select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().distinct()
    kind = dict(df.dtypes)[by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.unique(pdf[["x", "y"]].to_numpy(), axis=0)
        edges, triangles = simplices_of(p)
        key = pdf[by].iloc[0]
        out = [(key, "edge", i, j, -1, float(np.sqrt(((p[i] - p[j]) ** 2).sum())), *rest) for i, j, *rest in edges]
        out += [(key, "triangle", i, j, k, area_of(p[[i, j, k]]), *rest, None, None) for i, j, k, *rest in triangles]
        return pd.DataFrame(out, columns=[by, "kind", "i", "j", "k", "size", "a", "b", "c", "enter", "leave"])

    return rows.groupBy(by).applyInPandas(run, f"`{by}` {kind}, kind string, i long, j long, k long, size double, a double, b double, c double, enter double, leave double")


def _of_kind(simplices: DataFrame, alpha: float, kind: str) -> DataFrame:
    a, b, c = (F.col(x) <= alpha for x in "abc")
    return simplices.where({"all": a, "singular": a & ~b, "regular": b & ~c, "interior": c, "exterior": ~a}[kind])


def alpha_lines(simplices: DataFrame, alpha: float, kind: str = "all") -> DataFrame:
    """Edges at ``alpha``: all, singular, regular, interior, or exterior (not in the complex)."""
    return _of_kind(simplices.where("kind = 'edge'"), alpha, kind)


def alpha_triangles(simplices: DataFrame, alpha: float, kind: str = "all") -> DataFrame:
    """Triangles at ``alpha``, of the same kinds as edges."""
    return _of_kind(simplices.where("kind = 'triangle'"), alpha, kind)


def triangle_graph(simplices: DataFrame, alpha: float, kind: str = "all", by: str = "cluster_label") -> DataFrame:
    """Edges (``by``, a, b, triangle) of the triangles at ``alpha``, one row per triangle and side; ``triangle`` lists its corners."""
    corners = F.array("i", "j", "k")
    side = F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ij", "jk", "ki"))))
    return alpha_triangles(simplices, alpha, kind).select(by, corners.alias("triangle"), side.alias("_s")).select(by, "_s.a", "_s.b", "triangle")


def alphas(simplices: DataFrame, by: str = "cluster_label") -> DataFrame:
    """(``by``, alpha): the values at which the shape changes; endless for edges of the hull."""
    return simplices.where("kind = 'edge'").select(by, F.explode(F.array("a", "b", "c")).alias("alpha")).distinct()


def alpha_shapes(simplices: DataFrame, alpha: float, by: str = "cluster_label") -> DataFrame:
    """Per group at ``alpha``: area of the triangles, length of their union's boundary, counts of both, and the numbers of
    points on edges of the complex and on regular edges."""
    t = alpha_triangles(simplices, alpha).groupBy(by).agg(F.sum("size").alias("region_measure_as"), F.count("*").alias("n_triangles"))
    e = simplices.where((F.col("enter") <= alpha) & (F.col("leave") > alpha)).groupBy(by).agg(F.sum("size").alias("subregion_measure_as"), F.count("*").alias("n_boundary_lines"))
    ends = lambda kind, name: alpha_lines(simplices, alpha, kind).select(by, F.explode(F.array("i", "j")).alias("_p")).groupBy(by).agg(F.countDistinct("_p").alias(name))
    out = simplices.select(by).distinct().join(t, by, "left").join(e, by, "left").join(ends("all", "n_points_alpha_shape"), by, "left").join(ends("regular", "n_points_on_boundary"), by, "left")
    return out.fillna(0.0, ["region_measure_as", "subregion_measure_as"]).fillna(0, ["n_triangles", "n_boundary_lines", "n_points_alpha_shape", "n_points_on_boundary"])


def optimal_alpha(simplices: DataFrame, by: str = "cluster_label") -> DataFrame:
    """Smallest alpha at which every edge's entry is reached."""
    return simplices.where("kind = 'edge'").groupBy(by).agg(F.max("a").alias("optimal_alpha"))


def alpha_components(simplices: DataFrame, alpha: float, by: str = "cluster_label") -> DataFrame:
    """(node, component) of the points connected by triangles at ``alpha`` (of a single group)."""
    return components(triangle_graph(simplices, alpha, by=by).select("a", "b"))


def expected_hull_area(n: int, sigma: float = 1) -> float:
    """Mean area of the convex hull of n points of a 2-D normal law: pi 3 C(n, 3) times the integral of
    the cubed density times the chance that the other points lie on one side of a line at that distance."""
    if n < 3:
        return 0.0
    t = np.linspace(-9, 9, 40_001)
    density, width = np.exp(-t * t / 2) / np.sqrt(2 * np.pi), t[1] - t[0]
    below = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2 * width)])
    f = (below / below[-1]) ** (n - 3) * density**3
    return float(np.pi * 3 * comb(n, 3) * np.sum((f[1:] + f[:-1]) / 2) * width) * sigma**2


def hull_expectation(hulls: DataFrame, column: str = "region_measure_ch", sigma: float = 1) -> DataFrame:
    """Mean hull area by number of points beside what is expected of normal clouds of that size, and their ratio."""
    out = hulls.groupBy("localization_count").agg(F.avg(column).alias(f"{column}_mean"), F.stddev_samp(column).alias(f"{column}_std"), F.count("*").alias("n_groups"))
    counts = [r["localization_count"] for r in out.select("localization_count").toLocalIterator()]  # distinct group sizes
    table = hulls.sparkSession.createDataFrame([(int(n), expected_hull_area(int(n), sigma)) for n in counts], "localization_count long, expectation double")
    return out.join(table, "localization_count").withColumn("ratio", F.col(f"{column}_mean") / F.when(F.col("expectation") > 0, F.col("expectation")))


def hull_expectation_batch(sets: Sequence[DataFrame], by: str = "cluster_label", sigma: float = 1) -> DataFrame:
    """Hulls of the groups of several sets pooled, beside what is expected of their sizes."""
    pooled = None
    for df in sets:
        own = convex_hulls(df, by).select("localization_count", "region_measure_ch")
        pooled = own if pooled is None else pooled.unionByName(own)
    return hull_expectation(pooled, sigma=sigma)


def rectangle_corners(v: np.ndarray) -> np.ndarray:
    """Corners, counter-clockwise, of the smallest rectangle around a convex polygon."""
    a = np.radians(rectangle_of(v)[2])
    axes = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
    (x0, y0), (x1, y1) = (v @ axes.T).min(0), (v @ axes.T).max(0)
    return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]]) @ axes


def by_cells(df: DataFrame, hulls: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Rows of ``df`` beside the hulls (arrays ``_lo``, ``_hi`` of their boxes) whose boxes share a grid cell with them.

    Every hull takes the grid whose edge is the power of two at or above its box's largest side, so it lies in at most two cells
    an axis however much the sizes differ; a point goes to one cell of each edge in use (they differ by doubling, so they are few)."""
    side = F.array_max(F.zip_with("_hi", "_lo", lambda a, b: a - b))
    box = hulls.withColumn("_edge", F.pow(F.lit(2.0), F.ceil(F.log2(F.when(side > 0, side).otherwise(1.0)))))
    edges = [r["_edge"] for r in box.select("_edge").distinct().toLocalIterator()]
    points = df.withColumn("_edge", F.explode(F.array(*map(F.lit, edges)).cast("array<double>")))
    cells = [f"_g{k}" for k in range(len(coords))]
    for k, c in enumerate(coords):
        at = lambda v: F.floor(v / F.col("_edge"))
        points = points.withColumn(cells[k], at(F.col(c).cast("double")))
        box = box.withColumn(cells[k], F.explode(F.sequence(at(F.col("_lo")[k]), at(F.col("_hi")[k]))))
    return points.join(box, ["_edge", *cells])


def localizations_in_hulls(df: DataFrame, collection: DataFrame, by: str = "cluster_label", hull: str = "convex") -> DataFrame:
    """Rows of ``df`` with the ``region_id`` of each hull of the collection's groups that holds them.

    ``hull`` is 'convex', 'bounding_box' or 'oriented_bounding_box'. Hulls meet the points by the cells that their boxes cover; the exact
    test is an expression over the hull's corners, boundaries included.
    """
    if hull not in ("convex", "bounding_box", "oriented_bounding_box"):
        raise ValueError("hull is convex, bounding_box or oriented_bounding_box")
    x, y = check_columns(df.columns, None)[:2]
    kind = dict(collection.dtypes)[by]

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        v = convex_hull(pdf[["x", "y"]].to_numpy())
        if hull == "bounding_box":
            (x0, y0), (x1, y1) = v.min(0), v.max(0)
            v = np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]])
        elif hull == "oriented_bounding_box":
            v = rectangle_corners(v)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "vx": [v[:, 0].tolist()], "vy": [v[:, 1].tolist()]})

    hulls = hull_vertices(collection, by).groupBy(by).applyInPandas(corners, f"`{by}` {kind}, vx array<double>, vy array<double>").where(F.size("vx") > 2)
    ends = lambda f: F.array(f("vx"), f("vy"))
    box = hulls.select(F.col(by).alias("region_id"), "vx", "vy", ends(F.array_min).alias("_lo"), ends(F.array_max).alias("_hi"))
    n = F.size("vx")
    turn = lambda k: (F.get("vx", (k + 1) % n) - F.get("vx", k)) * (F.col(y) - F.get("vy", k)) - (F.get("vy", (k + 1) % n) - F.get("vy", k)) * (F.col(x) - F.get("vx", k))
    inside = F.forall(F.sequence(F.lit(0), n - 1), lambda k: turn(k) >= 0)
    return by_cells(df, box, [x, y]).where(inside).select(*df.columns, "region_id")
