"""Row-wise transforms, registration and drift."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import check_columns, coordinates
from ..functions.binning import Bins
from .binned import histogram
from .components import written
from .spatial import nearest_neighbors


def rotation_2d(angle: float) -> np.ndarray:
    """Matrix of a turn by ``angle`` radians."""
    return np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])


def align_vectors(vector: Sequence[float], other: Sequence[float] = (1, 0)) -> float:
    """Angle in radians that turns ``other`` into the direction of ``vector``."""
    return math.atan2(other[0] * vector[1] - other[1] * vector[0], vector[0] * other[0] + vector[1] * other[1])


def _linear(coords: Sequence[str], matrix, offset, pre) -> dict[str, Column]:
    d = len(coords)
    m = np.eye(d) if matrix is None else np.array(matrix, float)
    o = np.zeros(d) if offset is None else np.array(offset, float)
    p = np.zeros(d) if pre is None else np.array(pre, float)
    out = {}
    for i, c in enumerate(coords):
        total = None
        for j, x in enumerate(coords):
            term = float(m[i, j]) * (F.col(x) + float(p[j]))
            total = term if total is None else total + term
        out[c] = total + float(o[i]) - float(p[i])
    return out


def transform_affine(df: DataFrame, matrix=None, offset=None, pre_translation=None) -> DataFrame:
    """Coordinates M (x + pre) + offset - pre, as doubles."""
    return df.withColumns(_linear(coordinates(df.columns), matrix, offset, pre_translation))


def homogeneous_matrix(matrix=None, offset=None, dimension: int = 2) -> np.ndarray:
    out = np.eye(dimension + 1)
    out[:dimension, :dimension] = np.eye(dimension) if matrix is None else matrix
    out[:dimension, dimension] = 0 if offset is None else offset
    return out


def standardize(df: DataFrame, columns: Sequence[str] | None = None, with_mean: bool = True, with_std: bool = True) -> DataFrame:
    """Columns less their mean over their deviation (dividing by n; a deviation of 0 counts as 1)."""
    columns = check_columns(df.columns, columns)
    stats = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(stats))  # one row is broadcast
    new = {}
    for c in columns:
        x = F.col(c) - F.col(f"_m_{c}") if with_mean else F.col(c)
        new[c] = x / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) if with_std else x
    return out.withColumns(new).drop(*stats.columns)


def overlay(df: DataFrame, by: str = "cluster_label", *, centers: str | None = "centroid", orientation: str | None = None) -> DataFrame:
    """Every group moved so that its center is at the origin, and turned back by its orientation.

    centers: 'centroid', 'bounding_box' or None; orientation: None or 'inertia'.
    """
    coords = coordinates(df.columns)
    if centers == "centroid":
        mid = df.groupBy(by).agg(*(F.avg(c).alias(f"_m_{c}") for c in coords))
    elif centers == "bounding_box":
        mid = df.groupBy(by).agg(*(((F.min(c) + F.max(c)) / 2).alias(f"_m_{c}") for c in coords))
    else:
        mid = df.groupBy(by).agg(*(F.lit(0.0).alias(f"_m_{c}") for c in coords))
    out = df.join(mid, by).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in coords}).drop(*(f"_m_{c}" for c in coords))
    if orientation == "inertia":
        from .properties import inertia_moments

        x, y = coords[:2]
        angle = inertia_moments(df, [by]).select(by, F.radians("orientation").alias("_a"))
        out = out.join(angle, by)
        out = out.withColumns({x: F.col(x) * F.cos("_a") + F.col(y) * F.sin("_a"), y: F.col(y) * F.cos("_a") - F.col(x) * F.sin("_a")}).drop("_a")
    return out


def counts_to_photons(df: DataFrame, columns: Sequence[str] = ("intensity",), *, offset: float = 0, gain: float = 1, electrons_per_count: float = 1) -> DataFrame:
    """(I - offset) electrons / gain; a column whose metadata say it counts photons stays as it is, the others get that mark."""
    new = {}
    for c in check_columns(df.columns, list(columns)):
        if df.schema[c].metadata.get("unit") != "photons":
            new[c] = ((F.col(c) - offset) * electrons_per_count / gain).alias(c, metadata={"unit": "photons"})
    return df.select(*(new.get(c, F.col(c)) for c in df.columns))


def unwarp(df: DataFrame, dx: np.ndarray, dy: np.ndarray, pixel_size: float) -> DataFrame:
    """Coordinates moved by a displacement grid (one row of dx, dy per pixel), bilinear between its nodes.

    The grid is a table joined at the four corners around each point. A point outside the grid is an error.
    """
    spark = df.sparkSession
    h, w = dx.shape
    rows = [(int(j), int(i), float(dx[i, j]), float(dy[i, j])) for i in range(h) for j in range(w)]
    grid = spark.createDataFrame(rows, "gx int, gy int, u double, v double")
    x, y = coordinates(df.columns)[:2]
    out = df.withColumns({"_px": F.col(x) / pixel_size, "_py": F.col(y) / pixel_size})
    out = out.withColumns({"_ix": F.least(F.greatest(F.floor("_px"), F.lit(0)), F.lit(w - 2)).cast("int"), "_iy": F.least(F.greatest(F.floor("_py"), F.lit(0)), F.lit(h - 2)).cast("int")})
    for a in (0, 1):
        for b in (0, 1):
            corner = grid.select((F.col("gx") - a).alias("_ix"), (F.col("gy") - b).alias("_iy"), F.col("u").alias(f"_u{a}{b}"), F.col("v").alias(f"_v{a}{b}"))
            out = out.join(corner, ["_ix", "_iy"], "left")
    fx, fy = F.col("_px") - F.col("_ix"), F.col("_py") - F.col("_iy")
    mix = lambda n: (1 - fx) * (1 - fy) * F.col(f"_{n}00") + fx * (1 - fy) * F.col(f"_{n}10") + (1 - fx) * fy * F.col(f"_{n}01") + fx * fy * F.col(f"_{n}11")
    out = out.withColumns({"_nx": mix("u") * pixel_size, "_ny": mix("v") * pixel_size}).withColumns({x: F.col("_nx"), y: F.col("_ny")})
    inside = F.col("_px").between(0, w - 1) & F.col("_py").between(0, h - 1)
    refuse = F.raise_error(F.lit("a point lies outside the grid")).cast("double")
    return out.withColumns({c: F.when(inside | F.col("_px").isNull() | F.col("_py").isNull(), F.col(c)).otherwise(refuse) for c in (x, y)}).select(*df.columns)


def read_bunwarp_matrix(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) matrices of a raw transformation file: lines of width and height, then each matrix as rows under a title."""
    with open(path) as f:
        lines = f.read().splitlines()
    width, height = (int(line.split("=")[1]) for line in lines[:2])
    numbers = [np.array(line.split(), float) for line in lines[2:] if line.split() and line.split()[0].lstrip("-").replace(".", "", 1).isdigit()]
    both = np.concatenate(numbers).reshape(2, height, width)
    return both[0], both[1]


def bunwarp(df: DataFrame, path: str, pixel_size: float, flip: bool = False) -> DataFrame:
    """Coordinates through a raw transformation file; ``flip`` mirrors x about the image's width first."""
    mx, my = read_bunwarp_matrix(path)
    width = mx.shape[1] * pixel_size
    x = coordinates(df.columns)[0]
    return unwarp(df.withColumn(x, width - F.col(x)) if flip else df, mx, my, pixel_size)


@dataclass(frozen=True)
class Transformation:
    matrix: np.ndarray
    offset: np.ndarray


def _dense(df: DataFrame, bins: Bins, by: str | None = None) -> dict:
    """Images of counts on the driver: as many numbers as the bins have, whatever the rows."""
    names = [f"b{k}" for k in range(bins.dimension)]
    images: dict = {}
    for r in histogram(df, bins, by=[by] if by else []).collect():
        image = images.setdefault(r[by] if by else None, np.zeros(bins.n_bins))
        image[tuple(r[n] for n in names)] = r["count"]
    return images


def _shift(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shift in bins that moves image ``b`` onto ``a``: the peak of their cross-correlation, refined by a parabola."""
    c = np.fft.ifftn(np.fft.fftn(a) * np.conj(np.fft.fftn(b))).real
    peak = np.unravel_index(np.argmax(c), c.shape)
    out = []
    for k, p in enumerate(peak):
        n = c.shape[k]
        ends = [c[tuple((p + s) % n if j == k else q for j, q in enumerate(peak))] for s in (-1, 0, 1)]
        bend = ends[0] - 2 * ends[1] + ends[2]
        fine = 0.5 * (ends[0] - ends[2]) / bend if bend else 0.0
        out.append((p if p <= n // 2 else p - n) + fine)
    return np.array(out)


def register_cc(df: DataFrame, other: DataFrame, bins: Bins) -> Transformation:
    """Shift that moves ``other`` onto ``df``, by cross-correlation of their binned counts."""
    a, b = _dense(df, bins).get(None, np.zeros(bins.n_bins)), _dense(other, bins).get(None, np.zeros(bins.n_bins))
    return Transformation(np.eye(bins.dimension), _shift(a, b) * [s[0] for s in bins.bin_size])


def register_icp(df: DataFrame, other: DataFrame, *, matrix=None, offset=None, max_distance: float = 1000, max_iteration: int = 10_000, tolerance: float = 1e-6, with_scaling: bool = True, id_col: str = "index") -> Transformation:
    """Transformation of ``df`` onto ``other``: each round joins every point with its nearest in ``other`` and fits
    rotation, scale and shift to the pairs from their sums (one row of moments); stops when it moves no further."""
    coords = coordinates(df.columns)
    d = len(coords)
    m, o = np.eye(d) if matrix is None else np.array(matrix, float), np.zeros(d) if offset is None else np.array(offset, float)
    target = other.select(F.col(id_col).alias("neighbor"), *(F.col(c).alias(f"q{k}") for k, c in enumerate(coords)))
    for _ in range(max_iteration):
        moved = transform_affine(df, m, o)
        pairs = nearest_neighbors(moved, other, id_col=id_col).where(F.col("distance") <= max_distance).join(target, "neighbor")
        own = df.select(id_col, *(F.col(c).cast("double").alias(f"p{k}") for k, c in enumerate(coords)))
        p, q = [F.col(f"p{k}") for k in range(d)], [F.col(f"q{k}") for k in range(d)]
        r = pairs.join(own, id_col).agg(*(F.avg(x) for x in p + q), *(F.covar_pop(x, y) for y in q for x in p), *(F.var_pop(x) for x in p)).first()
        if r[0] is None:
            raise ValueError("no pairs within the distance")
        mp, mq, cov = np.array(r[:d]), np.array(r[d : 2 * d]), np.array(r[2 * d : 2 * d + d * d]).reshape(d, d)
        u, s, vt = np.linalg.svd(cov)
        sign = np.ones(d)
        sign[-1] = np.sign(np.linalg.det(u @ vt)) or 1
        rot = u @ np.diag(sign) @ vt
        spread = sum(r[2 * d + d * d :])
        scale = float((s * sign).sum() / spread) if with_scaling and spread else 1.0
        new, shift = scale * rot, mq - scale * rot @ mp
        moved_by = np.abs(new - m).max() + np.abs(shift - o).max()
        m, o = new, shift
        if moved_by < tolerance:
            break
    return Transformation(m, o)


def estimate_drift(chunked: DataFrame, bins: Bins, target: str = "first") -> list[tuple[float, Transformation]]:
    """(mean frame, transformation onto the target) for each chunk, by cross-correlation with the first chunk
    or, added up, with the one before. One aggregation makes the images of all chunks."""
    images = _dense(chunked, bins, "chunk")
    frames = {r["chunk"]: r["f"] for r in chunked.groupBy("chunk").agg(F.avg("frame").alias("f")).collect()}  # one row per chunk
    order, out, so_far = sorted(images), [], np.zeros(bins.dimension)
    for k, c in enumerate(order):
        if target == "first":
            step = _shift(images[order[0]], images[c])
        else:
            so_far = so_far + (_shift(images[order[k - 1]], images[c]) if k else 0)
            step = so_far
        out.append((frames[c], Transformation(np.eye(bins.dimension), step * [s[0] for s in bins.bin_size])))
    return out


def estimate_drift_icp(chunked: DataFrame, target: str = "first", *, max_distance: float = 100, **options) -> list[tuple[float, Transformation]]:
    """(mean frame, transformation onto the first chunk) for each chunk, by closest points with the first chunk or with the one
    before, whose transformations are then composed (without scaling). ``options`` go to :func:`register_icp`."""
    if target not in ("first", "previous"):
        raise ValueError("target is first or previous")
    chunked = written(chunked)  # read once per chunk and round
    frames = [(r["chunk"], r["f"]) for r in chunked.groupBy("chunk").agg(F.avg("frame").alias("f")).orderBy("chunk").collect()]  # one row per chunk
    d = len(coordinates(chunked.columns))
    out: list[tuple[float, Transformation]] = []
    part = lambda k: chunked.where(F.col("chunk") == frames[k][0]).drop("chunk")
    options = ({"with_scaling": False} if target == "previous" else {}) | {"max_distance": max_distance} | options
    for k, (_, frame) in enumerate(frames):
        if k == 0:
            out.append((frame, Transformation(np.eye(d), np.zeros(d))))
            continue
        step = register_icp(part(k), part(0 if target == "first" else k - 1), **options)
        if target == "previous":
            before = out[-1][1]
            step = Transformation(before.matrix @ step.matrix, before.matrix @ step.offset + before.offset)
        out.append((frame, step))
    return out


def cubic_pieces(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (cubic first, in x less the piece's start) of the cubic spline through at least four points of rising x,
    whose outer two pieces on each side are one polynomial."""
    h, n = np.diff(x), len(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        b[k] = 6 * ((y[k + 1] - y[k]) / h[k] - (y[k] - y[k - 1]) / h[k - 1])
    a[0, :3] = h[1], -h[0] - h[1], h[0]
    a[-1, -3:] = h[-1], -h[-1] - h[-2], h[-2]
    m = np.linalg.solve(a, b)
    return np.column_stack([np.diff(m) / (6 * h), m[:-1] / 2, np.diff(y) / h - h * (2 * m[:-1] + m[1:]) / 6, y[:-1]])


class DriftComponent:
    """One component over time: none, zero, one, constant, linear, polynomial (of ``degree``), spline, or ``basis``: the
    least-squares sum of functions that take numbers and columns alike.

    A spline is one cubic if its squared residuals sum up to at most ``smoothing``, else the cubic spline through all
    points; with fewer than four points, the polynomial through them. Points may come in any order; repeated frames are averaged.
    """

    def __init__(self, kind: str = "linear", *, degree: int = 3, smoothing: float = 100, basis: Sequence[Callable] = ()) -> None:
        if kind not in ("none", "zero", "one", "constant", "linear", "polynomial", "spline", "basis"):
            raise ValueError(f"no drift model {kind}")
        self.kind, self.smoothing, self.basis = kind, smoothing, list(basis)
        self.degree = {"constant": 0, "linear": 1, "polynomial": degree, "spline": 3}.get(kind)
        self.coefficients, self.starts, self.pieces = None, None, None

    def fit(self, x, y) -> "DriftComponent":
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.coefficients = self.starts = self.pieces = None
        if self.kind == "none":
            raise ValueError("no model to fit")
        if self.kind == "basis":
            self.coefficients = np.linalg.lstsq(np.column_stack([np.broadcast_to(np.asarray(f(x), float), x.shape) for f in self.basis]), y, rcond=None)[0]
        elif self.degree is not None:
            self.coefficients = np.polyfit(x, y, min(self.degree, len(set(x.tolist())) - 1))
            knots = np.unique(x)
            if self.kind == "spline" and len(knots) > 3 and ((np.polyval(self.coefficients, x) - y) ** 2).sum() > self.smoothing:
                self.starts, self.pieces = knots[:-1], cubic_pieces(knots, np.array([y[x == k].mean() for k in knots]))
        return self

    def _check(self) -> None:
        if self.kind == "none" or (self.coefficients is None and self.kind not in ("zero", "one")):
            raise ValueError("no fitted model")

    def eval(self, x):
        self._check()
        x = np.asarray(x, float)
        if self.kind in ("zero", "one"):
            return np.full(x.shape, float(self.kind == "one"))
        if self.kind == "basis":
            return sum(c * f(x) for c, f in zip(self.coefficients, self.basis))
        if self.pieces is None:
            return np.polyval(self.coefficients, x)
        k = np.searchsorted(self.starts[1:], x, side="right")
        return sum(self.pieces[k, j] * (x - self.starts[k]) ** (3 - j) for j in range(4))

    def column(self, frame: Column) -> Column:
        """The component as an expression of the frame; a spline holds as many numbers as the drift has chunks."""
        self._check()
        if self.kind in ("zero", "one"):
            return F.lit(float(self.kind == "one"))
        if self.kind == "basis":
            return sum((F.lit(float(c)) * f(frame) for c, f in zip(self.coefficients, self.basis)), F.lit(0.0))
        out = F.lit(0.0)
        if self.pieces is None:
            for c in self.coefficients.tolist():
                out = out * frame + F.lit(c)
            return out
        piece = F.size(F.filter(F.lit(self.starts[1:].tolist()), lambda start: start <= frame))
        t = frame - F.get(F.lit(self.starts.tolist()), piece)
        for j in range(4):
            out = out * t + F.get(F.lit(self.pieces[:, j].tolist()), piece)
        return out


@dataclass(frozen=True)
class DriftModels:
    """Fitted components of the matrix (row by row) and of the offset; None leaves that part out."""

    matrix: tuple[DriftComponent, ...] | None
    offset: tuple[DriftComponent, ...] | None


def fit_drift(drift: list[tuple[float, Transformation]], matrix_models: Sequence | None = None, offset_models: Sequence | None = None, chunks: slice = slice(None)) -> DriftModels:
    """Models (kinds or components, one per element; None: the element of the identity) fitted to the transformations over the
    mean frames, on a slice of the chunks if one is given."""
    drift = list(drift)[chunks]
    d = len(drift[0][1].offset)
    x = [f for f, _ in drift]

    def fitted(models, values, default) -> tuple[DriftComponent, ...] | None:
        if models is None:
            return None
        if len(models) != len(default):
            raise ValueError(f"{len(default)} models are needed")
        parts = [DriftComponent(e) if m is None else DriftComponent(m) if isinstance(m, str) else m for m, e in zip(models, default)]
        if len({id(c) for c in parts}) < len(parts):
            raise ValueError("every element needs a component of its own")
        return tuple(c.fit(x, [v[k] for v in values]) for k, c in enumerate(parts))

    identity = ["one" if i == j else "zero" for i in range(d) for j in range(d)]
    return DriftModels(fitted(matrix_models, [np.asarray(t.matrix, float).ravel() for _, t in drift], identity), fitted(offset_models, [t.offset for _, t in drift], ["zero"] * d))


def apply_drift_models(df: DataFrame, models: DriftModels, frame: str = "frame") -> DataFrame:
    """Coordinates M(frame) x + offset(frame), as expressions of each row; a null frame gives null coordinates."""
    if models.matrix is None and models.offset is None:
        raise ValueError("no fitted model")
    coords = coordinates(df.columns)
    d, t = len(coords), F.col(frame)
    new = {}
    for k, c in enumerate(coords):
        x = F.col(c)
        if models.matrix is not None:
            x = sum((models.matrix[k * d + j].column(t) * F.col(o) for j, o in enumerate(coords)), F.lit(0.0))
        new[c] = x + models.offset[k].column(t) if models.offset is not None else x
    return df.withColumns(new)


def apply_drift(df: DataFrame, drift: list[tuple[float, Transformation]], model: str = "linear") -> DataFrame:
    """Coordinates moved by the drift model fitted to each offset over the mean frames."""
    return apply_drift_models(df, fit_drift(drift, offset_models=[model] * len(coordinates(df.columns))))


def apply_chunk_transforms(chunked: DataFrame, drift: list[tuple[float, Transformation]]) -> DataFrame:
    """Each chunk moved by its own transformation (the first by the first)."""
    coords = coordinates(chunked.columns)
    d = len(coords)
    rows = [(k, np.asarray(np.eye(d) if t.matrix is None else t.matrix, float).ravel().tolist(), [float(o) for o in t.offset]) for k, (_, t) in enumerate(drift)]
    table = chunked.sparkSession.createDataFrame(rows, "chunk int, _m array<double>, _o array<double>")
    moved = {c: sum((F.get("_m", F.lit(k * d + j)) * F.col(o) for j, o in enumerate(coords)), F.lit(0.0)) + F.get("_o", F.lit(k)) for k, c in enumerate(coords)}
    return chunked.join(table, "chunk").withColumns(moved).drop("_m", "_o")


def linear_drift_correction(df: DataFrame, column: str = "position_x", frame: str = "frame") -> DataFrame:
    """``column`` less its regression line over the frame: one pass for the line, then arithmetic."""
    line = df.agg(F.regr_slope(column, frame).alias("_k"), F.regr_intercept(column, frame).alias("_b"))
    return df.crossJoin(F.broadcast(line)).withColumn(f"{column}_corrected", F.col(column) - (F.col("_k") * F.col(frame) + F.col("_b"))).drop("_k", "_b")  # one row is broadcast
