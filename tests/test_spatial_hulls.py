"""Hulls in space against all triples of points, on odd groups, and points in hulls of very different sizes."""

import itertools
import math

import numpy as np
import pytest

from pinprick.operators import hulls, spatial_hulls

SCHEMA = "cluster_label string, position_x double, position_y double, position_z double, index long, region string"


def frame_of(spark, groups):
    rows = [(name, *map(float, p)) for name, points in groups.items() for p in points]
    return spark.createDataFrame([(*row, n, "own") for n, row in enumerate(rows)], SCHEMA)


def by_triples(p):
    """Volume, surface and corners by looking at every triangle."""
    volume = surface = 0.0
    corners = set()
    for i, j, k in itertools.combinations(range(len(p)), 3):
        normal = np.cross(p[j] - p[i], p[k] - p[i])
        side = (p - p[i]) @ normal
        side[[i, j, k]] = 0
        if (side <= 0).all() or (side >= 0).all():
            corners |= {i, j, k}
            surface += float(np.linalg.norm(normal)) / 2
            volume += abs(float((p.mean(0) - p[i]) @ normal)) / 6
    return volume, surface, corners


@pytest.mark.parametrize("seed", range(12))
def test_faces_are_those_of_all_triples(seed):
    rng = np.random.default_rng(seed)
    p = rng.normal(0, 1, (int(rng.integers(4, 35)), 3)) * rng.choice([1e-3, 1, 1e4]) + rng.choice([0, 100])
    tri = spatial_hulls.hull_faces(p)
    volume, surface, corners = by_triples(p)
    assert spatial_hulls.volume_of(p, tri) == pytest.approx(volume, rel=1e-8)
    assert spatial_hulls.surface_of(p, tri) == pytest.approx(surface, rel=1e-8)
    assert set(spatial_hulls.corners_of(p, tri).tolist()) == corners
    lengths, axes, center = spatial_hulls.smallest_box(p, tri)
    assert np.allclose(axes @ axes.T, np.eye(3)) and (np.abs((p - center) @ axes.T) <= lengths / 2 + 1e-9 * lengths[0]).all()
    assert (lengths[:-1] >= lengths[1:]).all() and volume <= lengths.prod() <= np.ptp(p, axis=0).prod() * 1.5


def test_regular_and_flat_groups(spark):
    turn = np.linalg.qr(np.random.default_rng(5).normal(0, 1, (3, 3)))[0]
    grid = np.array(list(itertools.product(range(4), repeat=3)), float)
    groups = {
        "grid": grid,  # most points lie in faces and on edges
        "turned": grid * [1, 2, 3] @ turn.T + 50,
        "plane": np.column_stack([grid[:16, 1:], np.full(16, 7.0)]) @ turn.T,
        "line": [(k, k, k) for k in range(4)],
        "one": [(1, 2, 3)] * 3,
        "two": [(0, 0, 0), (3, 4, 0)],
        "copies": np.repeat([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], 5, axis=0),
        None: [(0, 0, 0), (6, 0, 0), (0, 6, 0), (0, 0, 6), (math.nan, 0, 0)],
    }
    df = frame_of(spark, groups).repartition(3)
    got = {x.cluster_label: x for x in spatial_hulls.convex_hulls_in_space(df).collect()}
    assert set(got) == set(groups)
    for name, volume, surface, n, sides in (
        ("grid", 27, 54, 8, (3, 3, 3)), ("turned", 162, 198, 8, (9, 6, 3)), ("plane", 0, 0, 0, (3, 3, 0)), ("line", 0, 0, 0, (math.sqrt(27), 0, 0)),
        ("one", 0, 0, 0, (0, 0, 0)), ("two", 0, 0, 0, (5, 0, 0)), ("copies", 1 / 6, 1.5 + math.sqrt(3) / 2, 4, None), (None, 36, 54 + 18 * math.sqrt(3), 4, None),
    ):
        x = got[name]
        assert (x.region_measure_ch, x.subregion_measure_ch) == (pytest.approx(volume, abs=1e-7), pytest.approx(surface, abs=1e-7)), name
        assert x.n_vertices_ch == n and x.localization_count == (4 if name is None else len(groups[name]))
        if sides:
            assert (x.length_obb, x.width_obb, x.height_obb) == pytest.approx(sides, abs=1e-7), name
        assert (x.localization_density_ch is None) == (volume == 0)
    assert got["turned"].elongation_obb == pytest.approx(2 / 3) and got["turned"].region_measure_obb == pytest.approx(162)
    assert got["one"].elongation_obb is None
    none = df.where("false")
    assert spatial_hulls.convex_hulls_in_space(none).count() == 0
    assert spatial_hulls.localizations_in_space(df, none).count() == spatial_hulls.localizations_in_space(none, df).count() == 0
    with pytest.raises(ValueError):
        spatial_hulls.convex_hulls_in_space(df.drop("position_z"))


def test_a_group_over_many_partitions_is_one_hull(spark):
    p = np.random.default_rng(2).normal(0, 1, (4000, 3))
    df = frame_of(spark, {"hot": p, "rest": p[:50]}).repartition(7)
    sent = spatial_hulls.hull_corners(df, "cluster_label").count()
    assert sent < 1500  # corners of seven parts, not 4,050 rows
    got = {x.cluster_label: x for x in spatial_hulls.convex_hulls_in_space(df).collect()}
    for name, own in (("hot", p), ("rest", p[:50])):
        tri = spatial_hulls.hull_faces(own)
        assert got[name].region_measure_ch == pytest.approx(spatial_hulls.volume_of(own, tri), rel=1e-9)
        assert got[name].n_vertices_ch == len(np.unique(tri))


@pytest.mark.parametrize("hull", ["convex", "bounding_box", "oriented_bounding_box"])
def test_points_in_hulls_of_any_size(spark, hull):
    rng = np.random.default_rng(3)
    groups = {"small": rng.normal(0, 0.01, (20, 3)), "middle": rng.normal(1, 1, (20, 3)), "huge": rng.normal(0, 1e5, (20, 3)), "flat": [(0, 0, 0), (1, 0, 0), (0, 1, 0)]}
    points = frame_of(spark, {"x": np.concatenate([*groups.values(), rng.normal(0, 1, (200, 3)), rng.normal(0, 1e5, (200, 3))])})
    got = {(x["index"], x.region_id) for x in spatial_hulls.localizations_in_space(points, frame_of(spark, groups), hull=hull).collect()}
    want = set()
    for name, p in groups.items():
        p = np.array(p, float)
        tri = spatial_hulls.hull_faces(p)
        for row in points.collect() if len(tri) else ():
            q = np.array(row[1:4])
            if hull == "convex":
                inside = spatial_hulls.volume_of(np.vstack([p, q]), spatial_hulls.hull_faces(np.vstack([p, q]))) <= spatial_hulls.volume_of(p, tri) * (1 + 1e-7)
            elif hull == "bounding_box":
                inside = ((q >= p.min(0)) & (q <= p.max(0))).all()
            else:
                lengths, axes, center = spatial_hulls.smallest_box(p, tri)
                inside = (np.abs((q - center) @ axes.T) <= lengths / 2 + 1e-9 * lengths[0]).all()
            if inside:
                want.add((row["index"], name))
    assert got == want
    assert {name for _, name in got} == {"small", "middle", "huge"}


def test_planar_hulls_of_any_size(spark):
    groups = {"small": [(0, 0, 0), (0.01, 0, 0), (0, 0.01, 0)], "huge": [(-1e6, -1e6, 0), (1e6, -1e6, 0), (0, 1e6, 0)]}
    points = frame_of(spark, {"x": [(0.002, 0.002, 0), (5, 5, 0), (9e5, 9e5, 0)]}).drop("position_z")
    met = hulls.localizations_in_hulls(points, frame_of(spark, groups).drop("position_z"))
    assert {(x["index"], x.region_id) for x in met.collect()} == {(0, "small"), (0, "huge"), (1, "huge")}
