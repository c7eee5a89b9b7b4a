"""Drift models, closest points, turns, alpha shapes, hull regions and centres against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinprick.analysis import Roi
from pinprick.functions.regions import Ellipse, Rectangle
from pinprick.functions.rotations import RATIO_FWHM_TO_SIGMA, Rotation2D, Rotation3D
from pinprick.operators import hulls, simulate
from pinprick.operators.transforms import DriftComponent, Transformation, apply_chunk_transforms, apply_drift_models, estimate_drift_icp, fit_drift


def frame_of(spark, points):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "index long, position_x double, position_y double")


def test_turns():
    a, b = Rotation2D.from_angle(30, degrees=True), Rotation2D.from_matrix([[0, -1], [1, 0]])
    assert np.allclose(a.inv().apply(a.apply([[1, 2], [3, 4]])), [[1, 2], [3, 4]])
    assert math.isclose((a * b).as_angle(degrees=True), 120)
    assert math.isclose(Rotation2D.align_vectors((0, 2)).as_angle(), math.pi / 2)
    with pytest.raises(ValueError):
        Rotation2D.from_matrix([[1, 0], [0, -1]])
    rng = np.random.default_rng(3)
    for _ in range(20):
        r, s = (Rotation3D.from_quat(rng.normal(size=4)) for _ in range(2))
        m = r.as_matrix()
        assert np.allclose(m @ m.T, np.eye(3)) and math.isclose(np.linalg.det(m), 1)
        assert np.allclose((r * s).as_matrix(), m @ s.as_matrix()) and np.allclose(r.inv().as_matrix(), m.T)
        assert np.allclose(Rotation3D.from_matrix(m).as_matrix(), m) and np.allclose(Rotation3D.from_rotvec(r.as_rotvec()).as_matrix(), m)
    z, x = Rotation3D.from_euler("z", 90, degrees=True), Rotation3D.from_euler("x", 90, degrees=True)
    assert np.allclose(z.apply([1, 0, 0]), [0, 1, 0])
    assert np.allclose(Rotation3D.from_euler("zx", [90, 90], degrees=True).as_matrix(), (x * z).as_matrix())
    assert np.allclose(Rotation3D.from_euler("ZX", [90, 90], degrees=True).as_matrix(), (z * x).as_matrix())
    assert Rotation3D().magnitude() == 0 and math.isclose(RATIO_FWHM_TO_SIGMA, 2.3548200450309493)


def test_drift_components(spark):
    x = np.array([0, 10, 25, 30, 55, 70.0])
    y = np.array([3, 1, 4, 1, 5, 9.0])
    spline = DriftComponent("spline", smoothing=0).fit(x[::-1], y[::-1])
    assert np.allclose(spline.eval(x), y)
    cubic = lambda t: 1e-3 * t**3 - t**2 + 2 * t - 7
    exact = DriftComponent("spline", smoothing=-1).fit(x, cubic(x))
    at = np.linspace(-20, 90, 23)
    assert np.allclose(exact.eval(at), cubic(at))
    smooth = DriftComponent("spline").fit(x, y)  # residuals of the cubic stay below 100
    assert np.allclose(smooth.eval(at), np.polyval(np.polyfit(x, y, 3), at))
    assert np.allclose(DriftComponent("spline", smoothing=0).fit([1, 2], [3, 5]).eval([1.5]), 4)
    frames = spark.createDataFrame([(float(t),) for t in at], "t double")
    for c in (spline, exact, smooth, DriftComponent("linear").fit(x, y), DriftComponent("one")):
        got = sorted((r.t, r.v) for r in frames.select("t", c.column(F.col("t")).alias("v")).collect())
        assert np.allclose([v for _, v in got], c.eval(at))
    with pytest.raises(ValueError):
        DriftComponent("none").fit(x, y)
    with pytest.raises(ValueError):
        DriftComponent("linear").eval(1)
    with pytest.raises(ValueError):
        DriftComponent("cubist")


def test_drift_models(spark):
    drift = [(float(f), Transformation(np.array([[1, f], [0, 1]]), np.array([2 * f, 0]))) for f in (0, 1, 2, 3)]
    df = spark.createDataFrame([(0, 1.0, 2.0, 5), (1, 3.0, 4.0, None)], "index long, position_x double, position_y double, frame long")
    rows = {r["index"]: r for r in apply_drift_models(df, fit_drift(drift, ["one", "linear", None, None], ["linear", None])).collect()}
    assert math.isclose(rows[0].position_x, 1 + 5 * 2 + 10) and math.isclose(rows[0].position_y, 2)
    assert rows[1].position_x is None
    same = DriftComponent("linear")
    for bad in (dict(matrix_models=["one"]), dict(offset_models=[same, same])):
        with pytest.raises(ValueError):
            fit_drift(drift, **bad)
    with pytest.raises(ValueError):
        apply_drift_models(df, fit_drift(drift))
    late = fit_drift(drift, offset_models=["constant", None], chunks=slice(2, None))
    assert math.isclose(float(late.offset[0].eval(0)), 5)
    chunked = df.withColumn("chunk", F.lit(3))
    assert apply_chunk_transforms(chunked, drift).where("index = 0").first().position_x == 1 + 3 * 2 + 6


@pytest.mark.parametrize("target", ["first", "previous"])
def test_drift_by_closest_points(spark, target):
    rng = np.random.default_rng(5)
    base = np.array(list(itertools.product(range(0, 50, 10), range(0, 50, 10)))) + rng.uniform(-1, 1, (25, 2))
    rows = [(c * 25 + k, float(x + 0.7 * c), float(y - 0.4 * c), c, c * 10) for c in range(3) for k, (x, y) in enumerate(base)]
    df = spark.createDataFrame(rows, "index long, position_x double, position_y double, chunk int, frame long")
    drift = estimate_drift_icp(df, target, with_scaling=False, max_distance=4, tolerance=1e-3)
    assert [f for f, _ in drift] == [0, 10, 20]
    moved = apply_chunk_transforms(df, drift).orderBy("index").collect()
    assert np.allclose([(r.position_x, r.position_y) for r in moved], np.tile(base, (3, 1)), atol=1e-3)
    for _, t in drift:
        assert np.allclose(t.matrix @ t.matrix.T, np.eye(2), atol=1e-6)


def test_alpha_shapes_against_all_triples(spark):
    """Triangles whose circumcircle is empty, by trying all; the complex takes them by their longest half edge."""
    rng = np.random.default_rng(11)
    p = rng.uniform(0, 10, (14, 2))
    df = frame_of(spark, p).withColumn("cluster_label", F.lit(1).cast("long"))
    simplices = hulls.alpha_complex(df).cache()
    order = np.lexsort((p[:, 1], p[:, 0]))
    q = p[order]
    found = []
    for t in itertools.combinations(range(len(q)), 3):
        a, b, c = q[list(t)]
        m = 2 * np.array([b - a, c - a])
        center = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
        if all(((q[k] - center) ** 2).sum() >= ((a - center) ** 2).sum() - 1e-9 for k in range(len(q)) if k not in t):
            found.append(t)
    half = lambda i, j: math.dist(q[i], q[j]) / 2
    enters = {t: max(half(i, j) for i, j in itertools.combinations(t, 2)) for t in found}
    edges = {e for t in found for e in itertools.combinations(t, 2)}
    assert {tuple(sorted((r.i, r.j))) for r in simplices.where("kind = 'edge'").collect()} == edges
    for alpha in (0.8, 1.3, 1.8, 2.5, 100):
        kept = [t for t in found if enters[t] <= alpha]
        sides = [e for t in kept for e in itertools.combinations(t, 2)]
        rim = [e for e in set(sides) if sides.count(e) == 1]
        got = hulls.alpha_shapes(simplices, alpha).first()
        area = sum(abs(np.cross(*(np.append(q[t[k]] - q[t[0]], 0) for k in (1, 2)))[2]) / 2 for t in kept)
        assert math.isclose(got.region_measure_as, area, abs_tol=1e-9) and got.n_triangles == len(kept)
        assert math.isclose(got.subregion_measure_as, sum(2 * half(*e) for e in rim), abs_tol=1e-9) and got.n_boundary_lines == len(rim)
        inside = {e for e in edges if half(*e) <= alpha}
        assert {tuple(sorted((r.i, r.j))) for r in hulls.alpha_lines(simplices, alpha).collect()} == inside
        assert hulls.alpha_lines(simplices, alpha, "exterior").count() == len(edges) - len(inside)
        assert got.n_points_alpha_shape == len({k for e in inside for k in e})
        assert hulls.triangle_graph(simplices, alpha).count() == 3 * len(kept)
        label = list(range(len(q)))
        for t in kept * len(q):
            low = min(label[k] for k in t)
            for k in t:
                label[k] = low
        nodes = {k for t in kept for k in t}
        got = {}
        for r in hulls.alpha_components(simplices, alpha).collect():
            got.setdefault(r.component, set()).add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(sorted(k for k in nodes if label[k] == c) for c in {label[k] for k in nodes})
    assert math.isclose(hulls.optimal_alpha(simplices).first().optimal_alpha, max(half(*e) for e in edges))
    values = {r.alpha for r in hulls.alphas(simplices).collect()}
    assert {round(half(*e), 9) for e in edges} <= {round(v, 9) for v in values} and float("inf") in values


def test_randomize_in_hulls(spark):
    df = frame_of(spark, [(0, 0), (4, 0), (0, 4), (1, 1), (1, 2)])
    for hull, inside in (("ch", lambda x, y: x + y <= 4), ("obb", lambda x, y: True), (Ellipse((0, 0), 2, 2, 0), lambda x, y: x * x + y * y < 1)):
        rows = simulate.randomize(df, seed=3, hull=hull).collect()
        assert len(rows) == 5 and all(inside(r.position_x, r.position_y) for r in rows)
    with pytest.raises(ValueError):
        simulate.randomize(df, hull="circle")
    with pytest.raises(ValueError):
        simulate.randomize(frame_of(spark, [(0, 0), (1, 1)]), hull="ch")


def test_centers(spark):
    box = [(0, 5), (0, 5)]
    assert simulate.simulate_centers(spark, 4, box).count() == 4
    out = simulate.simulate_centers(spark, [(1, 1), (9, 9)], box, clip=False)
    assert sorted((r.cluster_label, r.position_x) for r in out.collect()) == [(0, 1.0), (1, 9.0)]
    assert simulate.simulate_centers(spark, [(1, 1), (9, 9)], box).count() == 1
    with pytest.raises(ValueError):
        simulate.simulate_centers(spark, [(1, 1)], box, offspring=[])
    with pytest.raises(ValueError):
        simulate.simulate_centers(spark, [(1, 1, 1)], box)


def test_roi_files(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "a_roi.yaml"
    path.write_text("reference: null\nregion: Rectangle((0, 0), 2, 1, 45)\nloc_properties:\n- position_x\n- position_y\n")
    roi = Roi.load(str(path))
    assert roi == Roi(Rectangle((0, 0), 2, 1, 45), "", ("position_x", "position_y"))
    path.write_text("reference: null\nregion: __import__('os')\nloc_properties: []\n")
    with pytest.raises(ValueError):
        Roi.load(str(path))
    roi.save(str(path))
    assert Roi.load(str(path)) == roi


def test_triangulation_looks_at_the_front_only(monkeypatch):
    looked, own = [], hulls._circles
    monkeypatch.setattr(hulls, "_circles", lambda q, tri: looked.append(len(tri)) or own(q, tri))
    stack = np.vstack
    widths: list[int] = []
    monkeypatch.setattr(hulls.np, "vstack", lambda parts: widths.append(sum(len(x) for x in parts)) or stack(parts))
    p = np.random.default_rng(5).normal(size=(3000, 2))
    tri = hulls.delaunay(p)
    widths.pop()  # the result
    hull = len(hulls.convex_hull(p))
    assert len(tri) == 2 * len(p) - 2 - hull and np.mean(widths) < 600  # all triangles so far: 3000 on average
