"""Hulls in space: convex hulls, smallest boxes and the points inside them, for groups of any size.

As in the plane, each partition first reduces every group to the corners of its own rows' hull, so a group meets in
one task as corners only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import check_columns
from .hulls import by_cells, convex_hull, diameter_of, rectangle_of

#: Faces are sought on whole numbers up to this, each moved by up to ``MOVED``, so that hardly any four points lie in a plane.
STEPS, MOVED = 2.0**44, 2**11
#: Points whose third (second) extent is below this share of the first lie in a plane (on a line).
FLAT = 1e-9


def _axes(p: np.ndarray) -> tuple[np.ndarray, int]:
    """Main axes of points as rows, and in how many of them the points extend."""
    _, s, axes = np.linalg.svd(np.linalg.qr(p - p.mean(0), mode="r"))
    return axes, int((s > FLAT * s[0]).sum()) if s[0] > 0 else 0


def hull_faces(p: np.ndarray) -> np.ndarray:
    """Triangles (row numbers, counter-clockwise from outside) of the convex hull of distinct points in space; none if they lie in a plane.

    The point farthest outside is joined to the rim of the faces that it sees, until none is outside. Coordinates are
    whole numbers here, and what a face sees is decided exactly, so grids and planes give closed hulls too."""
    if len(p) < 4 or _axes(p)[1] < 3:
        return np.zeros((0, 3), int)
    q = np.rint((p - p.min(0)) / np.ptp(p, axis=0).max() * STEPS) + np.random.default_rng(0).integers(-MOVED, MOVED, p.shape, endpoint=True)
    a = int(q[:, 0].argmin())
    b = int(((q - q[a]) ** 2).sum(1).argmax())
    c = int((np.cross(q - q[a], q[b] - q[a]) ** 2).sum(1).argmax())
    d = int(np.abs((q - q[a]) @ np.cross(q[b] - q[a], q[c] - q[a])).argmax())
    tri = np.array([[a, b, c], [a, c, d], [a, d, b], [b, d, c]])
    if _sides(q, np.array([d]), tri[:1])[0, 0] > 0:
        tri = tri[:, ::-1]
    rest, face, height = _above(q, np.setdiff1d(np.arange(len(q)), [a, b, c, d]), tri)
    while len(rest):
        i = rest[height.argmax()]
        seen = _sides(q, np.array([i]), tri)[0] > 0
        sides = np.concatenate([tri[seen][:, [0, 1]], tri[seen][:, [1, 2]], tri[seen][:, [2, 0]]])
        rim = sides[~np.isin(sides[:, 0] * len(q) + sides[:, 1], sides[:, 1] * len(q) + sides[:, 0])]
        new = np.column_stack([rim, np.full(len(rim), i)])
        lost = seen[face]  # points above a face that goes are inside now or above a new face
        moved, own, far = _above(q, rest[lost & (rest != i)], new)
        rest, height = np.concatenate([rest[~lost], moved]), np.concatenate([height[~lost], far])
        face = np.concatenate([(np.cumsum(~seen) - 1)[face[~lost]], own + int((~seen).sum())])
        tri = np.concatenate([tri[~seen], new])
    return tri


def _sides(q: np.ndarray, rows: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Per row and face six times the volume between them, positive outside: its sign is exact, by whole numbers where rounding could decide."""
    a = q[tri[:, 0]]
    u, v = q[tri[:, 1]] - a, q[tri[:, 2]] - a
    out = q[rows] @ np.cross(u, v).T - (np.cross(u, v) * a).sum(1)
    turns = ((1, 2), (2, 0), (0, 1))
    doubt = sum(np.abs(u[:, i] * v[:, j]) + np.abs(u[:, j] * v[:, i]) for i, j in turns) * STEPS * 2.0**-48
    r, f = np.nonzero(np.abs(out) <= doubt)
    if len(r):
        whole = lambda x: x.astype(np.int64).astype(object)
        u, v, w = whole(u[f]), whole(v[f]), whole(q[rows[r]] - a[f])
        exact = sum((u[:, i] * v[:, j] - u[:, j] * v[:, i]) * w[:, k] for k, (i, j) in enumerate(turns))
        out[r, f] = exact.astype(float)
    return out


def _above(q: np.ndarray, rest: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of ``rest`` that lie outside of a face, a face that is far below each, and how far; some points at a time."""
    size = np.linalg.norm(np.cross(q[tri[:, 1]] - q[tri[:, 0]], q[tri[:, 2]] - q[tri[:, 0]]), axis=1)
    step = max(1, 2_000_000 // max(len(tri), 1))
    out = [(rest[:0], np.zeros(0, int), np.zeros(0))]
    for k in range(0, len(rest), step):
        part = rest[k : k + step]
        h = _sides(q, part, tri) / np.maximum(size, 1.0)
        best = h.argmax(1)
        h = h[np.arange(len(part)), best]
        out.append((part[h > 0], best[h > 0], h[h > 0]))
    return tuple(np.concatenate(x) for x in zip(*out))


def solid_hull(p: np.ndarray) -> np.ndarray:
    """Those of the distinct points that a hull needs: corners of its faces; of a plane's points the corners of their polygon, of a line's its ends."""
    p = np.unique(p, axis=0)
    if len(p) < 4:
        return p
    axes, n = _axes(p)
    if n == 3:
        return p[np.unique(hull_faces(p))]
    if n < 2:
        at = (p - p[0]) @ axes[0]
        return p[[at.argmin(), at.argmax()]]
    flat = (p - p[0]) @ axes[:2].T
    corners = {tuple(c) for c in convex_hull(flat).tolist()}
    return p[[tuple(c) in corners for c in flat.tolist()]]


def _normals(p: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals of the faces, and which faces are wide enough to have one; the others' are 0."""
    cross = np.cross(p[tri[:, 1]] - p[tri[:, 0]], p[tri[:, 2]] - p[tri[:, 0]])
    size = np.linalg.norm(cross, axis=1)
    real = size > 1e-8 * size.max()
    return np.where(real[:, None], cross / np.where(real, size, 1.0)[:, None], 0.0), real


def corners_of(p: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Row numbers of the points where faces of three or more directions meet; points within a face or on an edge are none."""
    normal, real = _normals(p, tri)
    normal = normal[real]
    spread = np.zeros((len(p), 3, 3))
    for k in range(3):
        np.add.at(spread, tri[real][:, k], normal[:, :, None] * normal[:, None, :])
    return np.flatnonzero(np.linalg.eigvalsh(spread)[:, 0] > 1e-14)


def volume_of(p: np.ndarray, tri: np.ndarray) -> float:
    p = p - p.mean(0)
    return abs(float((p[tri[:, 0]] * np.cross(p[tri[:, 1]], p[tri[:, 2]])).sum())) / 6


def surface_of(p: np.ndarray, tri: np.ndarray) -> float:
    return float(np.linalg.norm(np.cross(p[tri[:, 1]] - p[tri[:, 0]], p[tri[:, 2]] - p[tri[:, 0]]), axis=1).sum()) / 2


def smallest_box(p: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, axes as rows, centre) of the smallest box that lies with a side on a face of the hull, longest side first.

    Flat points get the smallest rectangle of their plane, points on a line their distance; other lengths are 0."""
    if not len(tri):
        axes, n = _axes(p)
        normals, of_face = axes[2:] if n else np.eye(3)[2:], np.zeros((0, 3))
    else:
        of_face, real = _normals(p, tri)
        normals = of_face[real]
        normals = normals[np.unique(np.round(normals, 9), axis=0, return_index=True)[1]]
    best = None
    for w in normals:
        u = np.cross(w, np.eye(3)[np.abs(w).argmin()])
        u = u / np.linalg.norm(u)
        plane = np.array([u, np.cross(w, u)])
        height = float(np.ptp(p @ w)) if len(tri) else 0.0
        rim = np.ones(len(p), bool)
        for side in (of_face @ w, -of_face @ w) if len(tri) else ():  # the outline seen along w lies between faces that look up and down
            own = np.zeros(len(p), bool)
            own[tri[side >= -1e-9]] = True
            rim &= own
        flat = convex_hull(p[rim] @ plane.T)
        if len(flat) > 2:
            angle = np.radians(rectangle_of(flat)[2])
        else:
            angle = np.arctan2(*(flat[-1] - flat[0])[::-1])
        turned = np.array([[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]]) @ plane
        lengths = np.append(np.ptp(p @ turned.T, axis=0), height)
        if best is None or lengths.prod() < best[0] * (1 - 1e-12):
            best = (lengths.prod(), lengths, np.vstack([turned, w]))
    _, lengths, axes = best
    lengths[lengths < FLAT * lengths.max()] = 0.0
    at = p @ axes.T
    center = (at.min(0) + at.max(0)) / 2 @ axes
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], axes[order], center


def hull_corners(df: DataFrame, by: str, coords: Sequence[str] | None = None) -> DataFrame:
    """(by, x, y, z): hull corners of every group, those of each partition only. Rows with a null or NaN coordinate are left out."""
    x, y, z = _space(df, coords)
    rows = df.select(F.col(by).alias("_by"), *(F.col(c).cast("double").alias(k) for c, k in ((x, "x"), (y, "y"), (z, "z")))).dropna(subset=["x", "y", "z"])

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for key, g in b.groupby("_by", sort=False, dropna=False):
                key = None if pd.isna(key) else key
                now = g[["x", "y", "z"]].to_numpy()
                held[key] = solid_hull(np.concatenate([held[key], now]) if key in held else now)
        for key, v in held.items():
            yield pd.DataFrame({"_by": [key] * len(v), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]})

    return rows.mapInPandas(reduce, rows.schema)


def _space(df: DataFrame, coords: Sequence[str] | None) -> list[str]:
    found = list(check_columns(df.columns, coords))
    if len(found) != 3:
        raise ValueError("hulls in space need three coordinates")
    return found


_MEASURES = "region_measure_ch double, subregion_measure_ch double, n_vertices_ch long, max_distance double, length_obb double, width_obb double, height_obb double, axes_obb array<double>, center_obb array<double>"


def convex_hulls_in_space(df: DataFrame, by: str = "cluster_label", coords: Sequence[str] | None = None) -> DataFrame:
    """One row per group (null is a group): volume, surface, corners and largest extent of the convex hull; sides (longest first), axes
    (one after another), centre, volume, surface and elongation (1 - shortest / longest) of the smallest box; the corners' share of the rows; density.

    Volume, surface and corners of points that lie in a plane are 0, and so are their density (null) and the sides that they do not extend in.
    Rows with a null coordinate do not count. Measures are exact but for roundings of 1e-9 of the span."""
    cols = _space(df, coords)
    n = df.select(F.col(by).alias("_by"), *cols).dropna(subset=cols).groupBy("_by").agg(F.count("*").alias("localization_count"))
    kind = dict(df.dtypes)[by]

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        p = solid_hull(pdf[["x", "y", "z"]].to_numpy())
        tri = hull_faces(p)
        sides, axes, center = smallest_box(p, tri)
        key = pdf["_by"].iloc[0]
        solid = (volume_of(p, tri), surface_of(p, tri), len(corners_of(p, tri))) if len(tri) else (0.0, 0.0, 0)
        row = [None if pd.isna(key) else key, *solid, diameter_of(p), *sides.tolist(), axes.ravel().tolist(), center.tolist()]
        return pd.DataFrame([row], columns=["_by", *(x.split()[0] for x in _MEASURES.split(", "))])

    out = hull_corners(df, by, cols).groupBy("_by").applyInPandas(measure, f"_by {kind}, {_MEASURES}").alias("m")
    out = out.join(n.alias("n"), F.col("m._by").eqNullSafe(F.col("n._by"))).drop(F.col("n._by"))
    a, b, c, volume = (F.col(x) for x in ("length_obb", "width_obb", "height_obb", "region_measure_ch"))
    return out.withColumnRenamed("_by", by).withColumns({
        "region_measure_obb": a * b * c,
        "subregion_measure_obb": 2 * (a * b + b * c + c * a),
        "elongation_obb": F.when(a > 0, 1 - c / a),
        "vertices_share_ch": F.col("n_vertices_ch") / F.col("localization_count"),
        "localization_density_ch": F.when(volume > 0, F.col("localization_count") / volume),
    })


def localizations_in_space(df: DataFrame, collection: DataFrame, by: str = "cluster_label", hull: str = "convex") -> DataFrame:
    """Rows of ``df`` with the ``region_id`` of each solid hull of the collection's groups that holds them.

    ``hull`` is 'convex', 'bounding_box' or 'oriented_bounding_box'. Hulls become planes, points meet them by grid cell, and an
    expression over the planes decides; points within 1e-9 of the group's extent of a boundary are inside. Groups that lie in a plane hold nothing."""
    if hull not in ("convex", "bounding_box", "oriented_bounding_box"):
        raise ValueError("hull is convex, bounding_box or oriented_bounding_box")
    cols = _space(df, None)
    kind = dict(collection.dtypes)[by]

    def planes(pdf: pd.DataFrame) -> pd.DataFrame:
        p = solid_hull(pdf[["x", "y", "z"]].to_numpy())
        tri = hull_faces(p)
        lo, hi = p.min(0), p.max(0)
        if not len(tri):
            normal, offset = np.zeros((0, 3)), np.zeros(0)
        elif hull == "convex":
            normal, real = _normals(p, tri)
            normal = normal[real]
            offset = (p @ normal.T).max(0)
        else:
            axes = np.eye(3) if hull == "bounding_box" else smallest_box(p, tri)[1]
            normal = np.vstack([axes, -axes])
            offset = (p @ normal.T).max(0)
            if hull == "oriented_bounding_box":
                at = p @ axes.T
                ends = np.array([[at[i, 0], at[j, 1], at[k, 2]] for i in (at[:, 0].argmin(), at[:, 0].argmax()) for j in (at[:, 1].argmin(), at[:, 1].argmax()) for k in (at[:, 2].argmin(), at[:, 2].argmax())]) @ axes
                lo, hi = ends.min(0), ends.max(0)
        near = 1e-9 * float((hi - lo).max())
        key = pdf["_by"].iloc[0]
        return pd.DataFrame({"region_id": [None if pd.isna(key) else key], "_planes": [np.column_stack([normal, offset + near]).tolist()], "_lo": [(lo - near).tolist()], "_hi": [(hi + near).tolist()]})

    solids = hull_corners(collection, by).groupBy("_by").applyInPandas(planes, f"region_id {kind}, _planes array<array<double>>, _lo array<double>, _hi array<double>").where(F.size("_planes") > 0)
    x, y, z = (F.col(c).cast("double") for c in cols)
    inside = F.forall("_planes", lambda w: w[0] * x + w[1] * y + w[2] * z <= w[3])
    return by_cells(df, solids, cols).where(inside).select(*df.columns, "region_id")
