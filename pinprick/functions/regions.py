"""Regions as predicates over coordinate columns, with their measures."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Region:
    """What all regions share. ``contains`` takes one column per axis."""

    dimension: int = 0

    @property
    def bounds(self) -> tuple[tuple[float, float], ...]:
        raise NotImplementedError

    def contains(self, x: Sequence[Column]) -> Column:
        raise NotImplementedError

    @property
    def extent(self) -> tuple[float, ...]:
        return tuple(hi - lo for lo, hi in self.bounds)

    @property
    def max_distance(self) -> float:
        return math.sqrt(sum(e * e for e in self.extent))

    def buffer(self, distance: float) -> "Region":
        """Everything within a distance of a planar region (round corners; boxes keep their corners)."""
        if self.dimension != 2:
            raise NotImplementedError("only boxes and planar regions have a buffer")
        return Buffered(self if isinstance(self, Polygon) else Polygon(tuple(self.points)), float(distance))

    def inside_bounds(self, x: Sequence[Column]) -> Column:
        out = F.lit(True)
        for c, (lo, hi) in zip(x, self.bounds):
            out = out & (c >= lo) & (c <= hi)
        return out


@dataclass(frozen=True)
class EmptyRegion(Region):
    dimension: int = 0
    region_measure: float = 0.0
    subregion_measure: float = 0.0

    @property
    def bounds(self):
        return ()

    def contains(self, x):
        return F.lit(False)


@dataclass(frozen=True)
class Box(Region):
    """[lo, hi) on every axis: interval, rectangle, cuboid or more."""

    lower: tuple[float, ...]
    upper: tuple[float, ...]

    @staticmethod
    def at(corner: Sequence[float], lengths: Sequence[float]) -> "Box":
        return Box(tuple(map(float, corner)), tuple(float(a + b) for a, b in zip(corner, lengths)))

    @property
    def dimension(self):
        return len(self.lower)

    @property
    def bounds(self):
        return tuple(zip(self.lower, self.upper))

    @property
    def centroid(self):
        return tuple((a + b) / 2 for a, b in self.bounds)

    @property
    def region_measure(self):
        return math.prod(self.extent)

    @property
    def subregion_measure(self):
        e = self.extent
        return {1: 2.0, 2: 2 * sum(e)}.get(len(e)) if len(e) < 3 else sum(2 * math.prod(e) / x for x in e)

    def contains(self, x):
        out = F.lit(True)
        for c, lo, hi in zip(x, self.lower, self.upper):
            out = out & (c >= lo) & (c < hi)
        return out

    @property
    def points(self):
        (x0, x1), (y0, y1) = self.bounds[:2]
        return ((x0, y0), (x0, y1), (x1, y1), (x1, y0))

    def buffer(self, distance: float) -> "Box":
        return Box(tuple(a - distance for a in self.lower), tuple(b + distance for b in self.upper))

    def intersection(self, other: "Box") -> "Box | EmptyRegion":
        lo, hi = tuple(map(max, self.lower, other.lower)), tuple(map(min, self.upper, other.upper))
        return Box(lo, hi) if all(a < b for a, b in zip(lo, hi)) else EmptyRegion(self.dimension)


def Interval(lower_bound: float = 0, upper_bound: float = 1) -> Box:  # noqa: N802
    return Box((float(lower_bound),), (float(upper_bound),))


def AxisOrientedRectangle(corner=(0, 0), width=1, height=1) -> Box:  # noqa: N802
    return Box.at(corner, (width, height))


def AxisOrientedCuboid(corner=(0, 0, 0), length=1, width=1, height=1) -> Box:  # noqa: N802
    return Box.at(corner, (length, width, height))


def AxisOrientedHypercuboid(corner=(0, 0, 0), lengths=(1, 1, 1)) -> Box:  # noqa: N802
    return Box.at(corner, lengths)


@dataclass(frozen=True)
class Rectangle(Region):
    """Rectangle turned by ``angle`` degrees about its corner, [lo, hi) in its own axes."""

    corner: tuple[float, float] = (0, 0)
    width: float = 1
    height: float = 1
    angle: float = 0
    dimension: int = field(default=2, init=False)

    @property
    def points(self):
        c, s = math.cos(math.radians(self.angle)), math.sin(math.radians(self.angle))
        return tuple((self.corner[0] + a * c - b * s, self.corner[1] + a * s + b * c) for a, b in ((0, 0), (0, self.height), (self.width, self.height), (self.width, 0)))

    @property
    def bounds(self):
        p = np.array(self.points)
        return tuple(zip(p.min(0).tolist(), p.max(0).tolist()))

    @property
    def centroid(self):
        return tuple(np.mean(self.points, axis=0).tolist())

    @property
    def region_measure(self):
        return self.width * self.height

    @property
    def subregion_measure(self):
        return 2 * (self.width + self.height)

    def contains(self, x):
        c, s = math.cos(math.radians(self.angle)), math.sin(math.radians(self.angle))
        dx, dy = x[0] - self.corner[0], x[1] - self.corner[1]
        u, v = dx * c + dy * s, dy * c - dx * s
        return self.inside_bounds(x) & (u >= 0) & (u < self.width) & (v >= 0) & (v < self.height)


@dataclass(frozen=True)
class Ellipse(Region):
    """Ellipse with full axes ``width`` and ``height``, turned by ``angle`` degrees; boundary excluded."""

    center: tuple[float, float] = (0, 0)
    width: float = 1
    height: float = 1
    angle: float = 0
    dimension: int = field(default=2, init=False)

    @property
    def bounds(self):
        c, s, a, b = math.cos(math.radians(self.angle)), math.sin(math.radians(self.angle)), self.width / 2, self.height / 2
        ex, ey = math.hypot(a * c, b * s), math.hypot(a * s, b * c)
        return ((self.center[0] - ex, self.center[0] + ex), (self.center[1] - ey, self.center[1] + ey))

    @property
    def centroid(self):
        return self.center

    @property
    def region_measure(self):
        return math.pi * self.width * self.height / 4

    @property
    def subregion_measure(self):
        a, b = self.width / 2, self.height / 2
        t = (np.arange(20000) + 0.5) * math.pi / 40000
        return float(4 * np.sqrt((a * np.cos(t)) ** 2 + (b * np.sin(t)) ** 2).mean() * math.pi / 2)

    @property
    def points(self):
        c, s = math.cos(math.radians(self.angle)), math.sin(math.radians(self.angle))
        t = np.arange(128) * 2 * math.pi / 128
        u, v = self.width / 2 * np.cos(t), self.height / 2 * np.sin(t)
        return tuple(zip((self.center[0] + u * c - v * s).tolist(), (self.center[1] + u * s + v * c).tolist()))

    def contains(self, x):
        c, s = math.cos(math.radians(self.angle)), math.sin(math.radians(self.angle))
        dx, dy = x[0] - self.center[0], x[1] - self.center[1]
        u, v = (dx * c + dy * s) / (self.width / 2), (dy * c - dx * s) / (self.height / 2)
        return self.inside_bounds(x) & (u * u + v * v < 1)


def _shoelace(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y) / 2)


@dataclass(frozen=True)
class Polygon(Region):
    """Even-odd polygon with holes; boundaries of the outer ring and of holes are no part of it."""

    points: tuple[tuple[float, float], ...] = ((0, 0), (0, 1), (1, 1), (1, 0))
    holes: tuple[tuple[tuple[float, float], ...], ...] = ()
    dimension: int = field(default=2, init=False)

    @property
    def rings(self) -> list[np.ndarray]:
        out = []
        for r in (self.points, *(self.holes or ())):
            p = np.array(r, float)
            out.append(p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p)
        return out

    @property
    def bounds(self):
        p = self.rings[0]
        return tuple(zip(p.min(0).tolist(), p.max(0).tolist()))

    @property
    def region_measure(self):
        outer, *holes = [abs(_shoelace(r)) for r in self.rings]
        return outer - sum(holes)

    @property
    def subregion_measure(self):
        return float(sum(np.sqrt(((r - np.roll(r, -1, 0)) ** 2).sum(1)).sum() for r in self.rings))

    @property
    def centroid(self):
        total, out = 0.0, np.zeros(2)
        for k, r in enumerate(self.rings):
            q = np.roll(r, -1, 0)
            cross = r[:, 0] * q[:, 1] - q[:, 0] * r[:, 1]
            a = cross.sum() / 2
            sign = (1 if k == 0 else -1) * (1 if a > 0 else -1)
            total += sign * a
            out += sign * ((r + q) * cross[:, None]).sum(0) / 6
        return tuple((out / total).tolist())

    def crossings(self, x: Sequence[Column]) -> Column:
        """Number of edges that a ray to the right crosses."""
        out = F.lit(0)
        for r in self.rings:
            for (x0, y0), (x1, y1) in zip(r.tolist(), np.roll(r, -1, 0).tolist()):
                if y0 != y1:
                    at = (x1 - x0) * (x[1] - y0) / (y1 - y0) + x0
                    out = out + F.when(((F.lit(y0) > x[1]) != (F.lit(y1) > x[1])) & (x[0] < at), 1).otherwise(0)
        return out

    def on_boundary(self, x: Sequence[Column]) -> Column:
        out = F.lit(False)
        for r in self.rings:
            for (x0, y0), (x1, y1) in zip(r.tolist(), np.roll(r, -1, 0).tolist()):
                cross = (x[0] - x0) * (y1 - y0) - (x[1] - y0) * (x1 - x0)
                within = (x[0] >= min(x0, x1)) & (x[0] <= max(x0, x1)) & (x[1] >= min(y0, y1)) & (x[1] <= max(y0, y1))
                out = out | ((cross == 0) & within)
        return out

    def contains(self, x):
        return self.inside_bounds(x) & (self.crossings(x) % 2 == 1) & ~self.on_boundary(x)

    def boundary_distance(self, x: Sequence[Column]) -> Column:
        each = []
        for r in self.rings:
            for (x0, y0), (x1, y1) in zip(r.tolist(), np.roll(r, -1, 0).tolist()):
                dx, dy = x1 - x0, y1 - y0
                n = dx * dx + dy * dy or 1.0
                t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x[0] - x0) * dx + (x[1] - y0) * dy) / n))
                px, py = x[0] - (t * dx + x0), x[1] - (t * dy + y0)
                each.append(F.sqrt(px * px + py * py))
        return F.least(*each) if len(each) > 1 else each[0]


@dataclass(frozen=True)
class MultiPolygon(Region):
    """Union of polygons that do not overlap."""

    polygons: tuple[Polygon, ...]
    dimension: int = field(default=2, init=False)

    @property
    def bounds(self):
        each = [p.bounds for p in self.polygons]
        return tuple((min(b[k][0] for b in each), max(b[k][1] for b in each)) for k in range(2))

    @property
    def region_measure(self):
        return sum(p.region_measure for p in self.polygons)

    @property
    def subregion_measure(self):
        return sum(p.subregion_measure for p in self.polygons)

    def buffer(self, distance):
        return Union(tuple(p.buffer(distance) for p in self.polygons))

    def contains(self, x):
        out = F.lit(False)
        for p in self.polygons:
            out = out | p.contains(x)
        return out


@dataclass(frozen=True)
class Buffered(Region):
    """Points of a polygon or within ``distance`` of its boundary. Its measure takes the circles at the corners as polygons of 32 corners and the same area."""

    region: Polygon
    distance: float
    dimension: int = field(default=2, init=False)

    def __post_init__(self):
        if self.distance < 0:
            raise ValueError("the distance is not negative")

    @property
    def bounds(self):
        return tuple((lo - self.distance, hi + self.distance) for lo, hi in self.region.bounds)

    @property
    def region_measure(self):
        return combined_measure(self.parts)

    @property
    def parts(self) -> "Union":
        """The polygon, a strip along each edge and a circle at each corner; of a convex polygon, its outline with an arc around each corner."""
        ring = self.region.rings[0] if _shoelace(self.region.rings[0]) > 0 else self.region.rings[0][::-1]
        ring = ring[(ring != np.roll(ring, 1, 0)).any(1)]
        along = np.roll(ring, -1, 0) - ring
        turn = np.roll(along, 1, 0)
        if self.distance and len(self.region.rings) == 1 and (turn[:, 0] * along[:, 1] - turn[:, 1] * along[:, 0] >= 0).all():
            out = np.arctan2(along[:, 1], along[:, 0]) - math.pi / 2
            arcs = []
            for corner, a, b in zip(ring, np.roll(out, 1), out):
                t = a + (b - a) % (2 * math.pi) * np.linspace(0, 1, 2 + int((b - a) % (2 * math.pi) * 32 / math.pi))
                arcs += (corner + self.distance * np.column_stack([np.cos(t), np.sin(t)])).tolist()
            return Union((Polygon(tuple(map(tuple, arcs))),))
        parts: list[Region] = [self.region]
        t = np.arange(32) * math.pi / 16
        circle = self.distance * math.sqrt(math.pi / (16 * math.sin(math.pi / 16))) * np.column_stack([np.cos(t), np.sin(t)])
        for r in self.region.rings:
            q = np.roll(r, -1, 0)
            along = q - r
            long = np.sqrt((along**2).sum(1))
            for a, b, u in zip(r[long > 0], q[long > 0], (along[:, ::-1] * [-1, 1])[long > 0] / long[long > 0, None]):
                parts.append(Polygon(tuple(map(tuple, (a - u * self.distance, b - u * self.distance, b + u * self.distance, a + u * self.distance)))))
            parts += [Polygon(tuple(map(tuple, (a + circle).tolist()))) for a in r]
        return Union(tuple(parts if self.distance else parts[:1]))

    def contains(self, x):
        return self.region.contains(x) | (self.region.boundary_distance(x) <= self.distance)


@dataclass(frozen=True)
class LineSegment(Region):
    """Segment in two or three dimensions; points on it by closeness of distance sums."""

    points: tuple[tuple[float, ...], tuple[float, ...]]
    is_directed: bool = True

    @property
    def dimension(self):
        return len(self.points[0])

    @property
    def bounds(self):
        return tuple((min(a, b), max(a, b)) for a, b in zip(*self.points))

    @property
    def region_measure(self):
        return math.dist(*self.points)

    @property
    def vector(self):
        return tuple(b - a for a, b in zip(*self.points))

    def contains(self, x):
        far = lambda p: F.sqrt(sum(((c - v) * (c - v) for c, v in zip(x, p)), F.lit(0.0)))
        return F.abs(far(self.points[0]) + far(self.points[1]) - self.region_measure) <= 1e-8 + 1e-5 * self.region_measure


@dataclass(frozen=True)
class Cuboid(Region):
    """Cuboid turned about its corner by yaw, pitch and roll (degrees); [lo, hi) in its own axes."""

    corner: tuple[float, float, float] = (0.0, 0.0, 0.0)
    length: float = 1.0
    width: float = 1.0
    height: float = 1.0
    alpha: float = 0.0
    beta: float = 0.0
    gamma: float = 0.0
    dimension: int = field(default=3, init=False)

    @property
    def matrix(self) -> np.ndarray:
        a, b, c = (math.radians(v) for v in (self.alpha, self.beta, self.gamma))
        z = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
        y = np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
        x = np.array([[1, 0, 0], [0, math.cos(c), -math.sin(c)], [0, math.sin(c), math.cos(c)]])
        return z @ y @ x

    @property
    def points(self):
        ends = np.array([[i, j, k] for i in (0, self.length) for j in (0, self.width) for k in (0, self.height)])
        return tuple(map(tuple, (np.array(self.corner) + ends @ self.matrix.T).tolist()))

    @property
    def bounds(self):
        p = np.array(self.points)
        return tuple(zip(p.min(0).tolist(), p.max(0).tolist()))

    @property
    def region_measure(self):
        return self.length * self.width * self.height

    @property
    def subregion_measure(self):
        return 2 * (self.length * self.width + self.length * self.height + self.width * self.height)

    def contains(self, x):
        out = self.inside_bounds(x)
        for col, size in zip(self.matrix.T.tolist(), (self.length, self.width, self.height)):
            u = sum(((c - o) * m for c, o, m in zip(x, self.corner, col)), F.lit(0.0))
            out = out & (u >= 0) & (u < size)
        return out


def region_from_intervals(intervals: Sequence[tuple[float, float]]) -> Box:
    return Box(tuple(float(a) for a, _ in intervals), tuple(float(b) for _, b in intervals))


def clip_convex(subject: Sequence[tuple[float, float]], window: Sequence[tuple[float, float]]) -> Polygon | EmptyRegion:
    """Intersection of a polygon with a convex one, edge by edge of the window."""
    w = np.array(window, float)
    if _shoelace(w) < 0:
        w = w[::-1]
    out = [tuple(p) for p in np.array(subject, float).tolist()]
    for (ax, ay), (bx, by) in zip(w.tolist(), np.roll(w, -1, 0).tolist()):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        points, out = out, []
        for p, q in zip(points, points[1:] + points[:1]):
            u, v = side(p), side(q)
            if u >= 0:
                out.append(p)
            if (u > 0 > v) or (u < 0 < v):
                t = u / (u - v)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            return EmptyRegion(2)
    return Polygon(tuple(out)) if len(out) > 2 and abs(_shoelace(np.array(out))) > 0 else EmptyRegion(2)


def expand_region(region: Region, distance: float = 100, support: Region | None = None) -> Region:
    """The region and everything within a distance, within the support."""
    grown = region.buffer(distance)
    if support is None:
        return grown
    return grown.intersection(support) if isinstance(grown, Box) and isinstance(support, Box) else Intersection(grown, support)


@dataclass(frozen=True)
class Difference(Region):
    """What is in one region and not in another."""

    region: Region
    without: Region

    @property
    def dimension(self):
        return self.region.dimension

    @property
    def bounds(self):
        return self.region.bounds

    @property
    def region_measure(self):
        return combined_measure(self)

    def contains(self, x):
        return self.region.contains(x) & ~self.without.contains(x)


@dataclass(frozen=True)
class Union(Region):
    """What is in any of the regions, which may overlap."""

    regions: tuple[Region, ...]

    @property
    def dimension(self):
        return self.regions[0].dimension

    @property
    def bounds(self):
        each = [r.bounds for r in self.regions if r.bounds]
        return tuple((min(b[k][0] for b in each), max(b[k][1] for b in each)) for k in range(self.dimension)) if each else ()

    @property
    def region_measure(self):
        return combined_measure(self)

    def contains(self, x):
        out = F.lit(False)
        for r in self.regions:
            out = out | r.contains(x)
        return out


@dataclass(frozen=True)
class Intersection(Region):
    """What is in both regions."""

    one: Region
    other: Region

    @property
    def dimension(self):
        return self.one.dimension

    @property
    def bounds(self):
        return tuple((max(a, c), min(b, d)) for (a, b), (c, d) in zip(self.one.bounds, self.other.bounds))

    @property
    def region_measure(self):
        return combined_measure(self)

    def contains(self, x):
        return self.one.contains(x) & self.other.contains(x)


def _spelled(region: Region) -> Region:
    """The same with buffered polygons as the unions of their parts."""
    if isinstance(region, Difference):
        return Difference(_spelled(region.region), _spelled(region.without))
    if isinstance(region, Intersection):
        return Intersection(_spelled(region.one), _spelled(region.other))
    if isinstance(region, Union):
        return Union(tuple(map(_spelled, region.regions)))
    return region.parts if isinstance(region, Buffered) else region


def _leaves(region: Region) -> list[Region]:
    """The regions that a combined one is made of, from left to right."""
    parts = {Difference: lambda r: (r.region, r.without), Intersection: lambda r: (r.one, r.other), Union: lambda r: r.regions}.get(type(region))
    return [x for r in parts(region) for x in _leaves(r)] if parts else [region]


def _holds(region: Region, inside: Iterator[np.ndarray]) -> np.ndarray:
    """Whether a combined region holds places of which it is known which leaves hold them."""
    if isinstance(region, Difference):
        one, other = _holds(region.region, inside), _holds(region.without, inside)
        return one & ~other
    if isinstance(region, Intersection):
        one, other = _holds(region.one, inside), _holds(region.other, inside)
        return one & other
    if isinstance(region, Union):
        return np.logical_or.reduce([_holds(r, inside) for r in region.regions])
    return next(inside)


def _edges(region: Region) -> np.ndarray:
    """(x0, y0, x1, y1) of the edges of a planar region's rings that are not upright, from left to right."""
    if isinstance(region, EmptyRegion):
        return np.zeros((0, 4))
    rings = [r for p in region.polygons for r in p.rings] if isinstance(region, MultiPolygon) else region.rings if isinstance(region, Polygon) else [np.array(region.points, float)]
    out = np.concatenate([np.column_stack([r, np.roll(r, -1, 0)]) for r in rings])
    out = np.where((out[:, 0] > out[:, 2])[:, None], out[:, [2, 3, 0, 1]], out)
    return out[out[:, 0] < out[:, 2]]


def combined_measure(region: Region) -> float:
    """Area of unions, intersections and differences of planar regions of any shape, or measure of those of boxes in any dimension.

    The plane is cut into upright strips at all corners and crossings: within a strip no edges cross, so it falls into trapezoids, each of which
    a leaf holds or not. Boxes are cut into the grid of all their sides. An ellipse counts as the polygon of its ``points``. Leaves are
    descriptions of a few hundred corners; the work grows with the square of their number.
    """
    region = _spelled(region)
    leaves = _leaves(region)
    if all(isinstance(r, (Box, EmptyRegion)) for r in leaves):
        boxes = [r for r in leaves if isinstance(r, Box)]
        if not boxes:
            return 0.0
        sides = [np.unique([v for b in boxes for v in (b.lower[k], b.upper[k])]) for k in range(boxes[0].dimension)]
        middle = np.meshgrid(*((x[1:] + x[:-1]) / 2 for x in sides), indexing="ij")
        size = np.prod(np.meshgrid(*(np.diff(x) for x in sides), indexing="ij"), axis=0)
        none = np.zeros(size.shape, bool)
        inside = [np.logical_and.reduce([(m >= lo) & (m < hi) for m, lo, hi in zip(middle, r.lower, r.upper)]) if isinstance(r, Box) else none for r in leaves]
        return float(size[_holds(region, iter(inside))].sum())
    if region.dimension != 2:
        raise NotImplementedError("combined measures are for planar regions, and for boxes in any dimension")
    each = [_edges(r) for r in leaves]
    edges, owner = np.concatenate(each), np.repeat(np.arange(len(leaves)), [len(e) for e in each])
    x0, y0, x1, y1 = edges.T
    slope = (y1 - y0) / (x1 - x0)
    cuts = [x0, x1]
    for k in range(len(edges)):  # crossings with the edges after it
        with np.errstate(divide="ignore", invalid="ignore"):
            at = ((y0[k] - slope[k] * x0[k]) - (y0[k:] - slope[k:] * x0[k:])) / (slope[k:] - slope[k])
        cuts.append(at[(at > np.maximum(x0[k], x0[k:])) & (at < np.minimum(x1[k], x1[k:]))])
    cuts, total = np.unique(np.concatenate(cuts)), 0.0
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        x = (lo + hi) / 2
        on = np.flatnonzero((x0 <= lo) & (x1 >= hi))
        y = y0[on] + slope[on] * (x - x0[on])
        order = np.argsort(y, kind="stable")
        y, mine = y[order], owner[on][order]
        inside = (np.cumsum(mine[:-1, None] == np.arange(len(leaves)), axis=0) % 2 == 1).T
        if len(y) > 1:
            total += (hi - lo) * float(np.diff(y)[_holds(region, iter(inside))].sum())
    return float(total)


def symmetric_difference(one: Region, other: Region) -> Union:
    """What is in exactly one of two regions."""
    return Union((Difference(one, other), Difference(other, one)))


def union_measure(one: Region, other: Region) -> float:
    """Measure of the union of two regions."""
    return Union((one, other)).region_measure


def regions_union(regions: Sequence[Region]) -> Union:
    return Union(tuple(regions))


def surrounding_region(region: Region, distance: float = 100, support: Region | None = None) -> Difference | EmptyRegion:
    grown = expand_region(region, distance, support)
    return grown if isinstance(grown, EmptyRegion) else Difference(grown, region)
