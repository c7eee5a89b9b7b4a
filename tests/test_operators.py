"""Operators on small inputs with known answers."""

import math
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinprick.analysis import Analysis, Pipeline, Roi, roi_from_legacy
from pinprick.dataset import LocSet
from pinprick.functions import distributions, regions
from pinprick.functions.binning import Bins, edges_from_size
from pinprick.lineage import Metadata
from pinprick.operators import binned, clustering, filters, frames, hulls, properties, simulate, spatial, spatial_stats, transforms
from pinprick.sources import files, native, smlm, text


@pytest.fixture(scope="module")
def points(spark):
    rows = [(0, 1.0, 1.0, 1, 100.0), (1, 1.0, 5.0, 2, 150.0), (2, 2.0, 3.0, 2, 110.0), (3, 3.0, 6.0, 4, 80.0), (4, 4.0, 2.0, 5, 105.0), (5, 5.0, 5.0, 6, 95.0)]
    return spark.createDataFrame(rows, "index long, position_x double, position_y double, frame long, intensity double")


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_weighted_mean_variance(spark):
    for x, w, want in (([1, 2], [1, 1], (1.5, 0.25)), ([1, 2], [1, 0], (1, 0)), ([1, 2], [1, -2], (3, 16)), ([1, 2], [1, 2], (1.667, 0.198))):
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, w)], "x double, w double")
        assert tuple(df.agg(*properties.weighted_moments(F.col("x"), F.col("w"))).first()) == pytest.approx(want, rel=1e-2)


def test_blinking(spark):
    df = spark.createDataFrame([(f,) for f in [0, 4, 6, 7, 8, 12, 13, 13]], "frame long")
    assert values(frames.on_periods(df), "frame", "period") == [(0, 1), (4, 1), (6, 3), (12, 2)]
    assert values(frames.off_periods(df), "frame", "period") == [(1, 3), (5, 1), (9, 3)]
    assert values(frames.on_periods(df, memory=1), "frame", "period") == [(0, 1), (4, 5), (12, 2)]
    assert values(frames.off_periods(df, memory=1), "frame", "period") == [(1, 3), (9, 3)]
    late = spark.createDataFrame([(3,), (4,)], "frame long")
    assert values(frames.off_periods(late, remove_heading_off_periods=False), "frame", "period") == [(0, 3)]
    assert frames.on_periods(df.limit(0)).count() == 0


def test_csr_densities(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(distributions.pdf_nn_csr_2d(F.col("x"), 1)).collect()] == pytest.approx([0, 2.715e-1, 4.382e-5], rel=1e-3)
    assert [r[0] for r in df.select(distributions.pdf_nn_csr_3d(F.col("x"), 1)).collect()] == pytest.approx([0, 1.906e-1, 1.406e-13], rel=1e-3)


def test_bessel_and_pairwise():
    t = (np.arange(200_000) + 0.5) * math.pi / 200_000
    for x in (0.0, 0.5, 3.0, 20.0, 40.0):
        assert distributions.bessel_i0(x) == pytest.approx(np.exp(x * np.cos(t)).mean(), rel=1e-5)
    x = np.linspace(0, 60, 200_001)
    assert np.trapezoid(distributions.pdf_pairwise_2d(x, 3, 2, 1), x) == pytest.approx(1, rel=1e-4)


@pytest.mark.parametrize("parts", [1, 8])
def test_radius_join_is_the_full_join(spark, parts):
    r = np.random.default_rng(0)
    p = np.round(r.normal(0, 3, (150, 3)), 1)
    df = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(p)] + [(900, None, 1.0, 1.0)], "index long, position_x double, position_y double, position_z double").repartition(parts)
    got = {(a, b) for a, b, _ in spatial.radius_pairs(df, radius=1.5).collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    assert got == {(int(a), int(b)) for a, b in np.argwhere(d <= 1.5) if a != b}
    near = {i: (j, x) for i, j, x in spatial.nearest_neighbors(df, k=2).select("index", "neighbor", "distance").collect()}
    for k in range(150):
        assert near[k][1] == pytest.approx(np.partition(np.delete(d[k], k), 1)[1])
    plan = spatial.radius_pairs(df, radius=1.5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_neighbors_of_few_points(spark, points):
    assert spatial.nearest_neighbors(points.limit(1)).count() == 0
    assert spatial.nearest_neighbors(points.limit(0)).count() == 0
    twice = points.limit(1).unionByName(points.limit(1).withColumn("index", F.lit(9).cast("long")))
    assert values(spatial.nearest_neighbors(twice), "index", "neighbor", "distance") == [(0, 9, 0.0), (9, 0, 0.0)]


def test_regions(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.5, 0.5), (0.0, 1.0), (2.0, 0.2), (0.3, 0.9)], "position_x double, position_y double")
    inside = lambda reg: [tuple(r) for r in filters.select_by_region(df, reg).collect()]
    assert inside(regions.AxisOrientedRectangle()) == [(0.0, 0.0), (0.5, 0.5), (0.3, 0.9)]
    assert inside(regions.Ellipse((0, 0), 2, 2)) == [(0.0, 0.0), (0.5, 0.5), (0.3, 0.9)]
    assert inside(regions.Polygon()) == [(0.5, 0.5), (0.3, 0.9)]
    holed = regions.Polygon(((0, 0), (0, 1), (1, 1), (1, 0)), (((0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)),))
    assert inside(holed) == [(0.3, 0.9)] and holed.region_measure == pytest.approx(0.96) and holed.centroid == pytest.approx((0.5, 0.5))
    assert inside(regions.EmptyRegion(2)) == []
    turned = regions.Rectangle((0, 0), 1, 1, 45)
    assert turned.region_measure == 1 and turned.centroid == pytest.approx((0, math.sqrt(0.5)))
    assert regions.Ellipse((0, 0), 2, 2).subregion_measure == pytest.approx(2 * math.pi)
    assert regions.clip_convex(((0, 0), (2, 0), (2, 2), (0, 2)), ((1, 1), (3, 1), (3, 3), (1, 3))).region_measure == pytest.approx(1)
    assert regions.Cuboid((0, 0, 0), 1, 2, 3, 20, 30, 40).region_measure == 6
    grown = regions.surrounding_region(regions.AxisOrientedRectangle(), 1)
    assert grown.region_measure == pytest.approx(8) and inside(grown) == [(1.0, 1.0), (0.0, 1.0)]
    line = regions.LineSegment(((0, 0), (1, 1)))
    assert inside(line) == [(0.0, 0.0), (1.0, 1.0), (0.5, 0.5)]


def test_polygon_turns_with_its_points(spark):
    r = np.random.default_rng(2)
    p, ring = r.uniform(-1, 1, (300, 2)), np.array([(-0.7, -0.6), (0.8, -0.5), (0.1, 0.1), (0.6, 0.9), (-0.6, 0.7)])
    m = transforms.rotation_2d(0.7)
    count = lambda q, v: filters.select_by_region(spark.createDataFrame(q.tolist(), "position_x double, position_y double"), regions.Polygon(tuple(map(tuple, v.tolist())))).count()
    assert count(p, ring) == count(p @ m.T, ring @ m.T) > 50


def test_bins():
    assert edges_from_size(3, 0, 10) == [0, 3, 6, 9]
    assert edges_from_size(3, 0, 10, True) == [0, 3, 6, 9, 12]
    assert edges_from_size(3, 0, 10, False) == [0, 3, 6, 9, 10]
    b = Bins.of(n_bins=[2, 4], bin_range=[(0, 1), (0, 2)])
    assert b.n_bins == (2, 4) and b.bin_centers[0] == (0.25, 0.75) and b.is_equally_sized == (True, True)
    with pytest.raises(ValueError):
        Bins.of(n_bins=2, bin_size=3, bin_range=(0, 1))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,), (-1.0,), (None,)], "position_x double")
    b = Bins.of(bin_edges=[0, 0.5, 2])
    assert values(binned.histogram(df, b), "b0", "count") == [(0, 1), (1, 2)]
    assert values(binned.cluster_by_bin(df, b), "b0", "cluster_count") == [(0, 1), (1, 1), (2, 2), (2, 2), (3, 1)]
    e = Bins.of(n_bins=2, bin_range=(0, 2))
    assert values(binned.histogram(df, e, dense=True), "b0", "count") == [(0, 2), (1, 1)]


def test_chunks(spark, points):
    sizes = lambda **o: [r["count"] for r in filters.chunks(points, order_by="index", **o).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes(chunk_size=4) == [4, 2] and sizes(chunk_size=4, drop=True) == [4]
    assert sizes(n_chunks=3) == [2, 2, 2] and sizes(n_chunks=4) == [2, 2, 2] and sizes(n_chunks=4, order="alternating") == [2, 2, 1, 1]
    assert sizes(chunks=[[0, 1], [5]]) == [2, 1]
    with pytest.raises(ValueError):
        filters.chunks(points, order_by="index", chunk_size=1, n_chunks=2)


def test_selection(spark, points):
    assert filters.select_by_condition(points, "1 < position_x <= 3").count() == 2
    assert filters.select_by_condition(points, [filters.Selector("position_x", True, 1, 4), filters.Selector("frame", False)]).count() == 2
    assert filters.random_subset(points, 4, replace=False, seed=1).distinct().count() == 4
    assert filters.random_subset(points, 50, seed=1).count() == 50
    assert filters.exclude_sparse_points(points, radius=2.3, min_samples=2).count() == 3
    assert filters.concat([points, points.drop("frame")]).select("index").distinct().count() == 12


def test_dbscan_and_sweep(spark):
    rows = [(0, 0.5, 0.5), (1, 1.0, 0.6), (2, 1.1, 1.0), (3, 5.0, 5.6), (4, 5.1, 6.0), (5, 5.5, 5.0), (6, 100.0, 100.0)]
    df = spark.createDataFrame(rows, "index long, position_x double, position_y double")
    assert [v for _, v in values(clustering.dbscan(df, eps=1.2, min_samples=2), "index", "cluster_label")] == [1, 1, 1, 2, 2, 2, -1]
    got = clustering.hdbscan(df, min_cluster_size=3)
    assert [v for _, v in values(got, "index", "cluster_label")][:6] == [1, 1, 1, 2, 2, 2]
    assert clustering.dbscan(df.limit(0), eps=1, min_samples=1).count() == 0
    with pytest.raises(ValueError):
        clustering.hdbscan(df, min_cluster_size=1)


def test_hulls(spark):
    r = np.random.default_rng(4)
    p = r.normal(0, 1, (400, 2))
    df = spark.createDataFrame([(k % 2, *map(float, q)) for k, q in enumerate(p)], "cluster_label long, position_x double, position_y double").repartition(5)
    for row in hulls.convex_hulls(df).collect():
        own = p[row.cluster_label :: 2]
        v = hulls.convex_hull(own)
        assert row.region_measure_ch == pytest.approx(hulls.area_of(v)) and row.localization_count == 200
        assert row.max_distance == pytest.approx(np.sqrt(((own[:, None] - own[None]) ** 2).sum(2)).max())
        assert row.region_measure_obb >= row.region_measure_ch
    square = spark.createDataFrame([(0, float(x), float(y)) for x in range(4) for y in range(3)] + [(1, 0.0, 0.0), (1, 1.0, 1.0)], "cluster_label long, position_x double, position_y double")
    out = {x.cluster_label: x for x in hulls.convex_hulls(square).collect()}
    assert out[0].region_measure_ch == 6 and out[0].length_obb == pytest.approx(3) and out[0].width_obb == pytest.approx(2) and out[1].region_measure_ch == 0
    assert hulls.expected_hull_area(3) == pytest.approx(math.sqrt(3) / 2, rel=1e-3)
    areas = [hulls.area_of(hulls.convex_hull(r.normal(0, 1, (10, 2)))) for _ in range(3000)]
    assert hulls.expected_hull_area(10) == pytest.approx(np.mean(areas), rel=0.03)


def test_alpha_shape_tends_to_the_hull(spark):
    r = np.random.default_rng(5)
    p = r.uniform(0, 1, (120, 2))
    tri = hulls.delaunay(p)
    center, r2 = hulls._circles(p, tri)
    assert not any((((p - c) ** 2).sum(1) < q * (1 - 1e-9)).any() for c, q in zip(center, r2))
    df = spark.createDataFrame([(0, *map(float, q)) for q in p], "cluster_label long, position_x double, position_y double")
    s = hulls.alpha_complex(df)
    wide, tight = (hulls.alpha_shapes(s, a).first() for a in (1e6, 0.08))
    v = hulls.convex_hull(p)
    assert wide.region_measure_as == pytest.approx(hulls.area_of(v), rel=1e-6) and wide.subregion_measure_as == pytest.approx(hulls.perimeter_of(v), rel=1e-6)
    assert 0 < tight.region_measure_as < wide.region_measure_as
    assert hulls.alpha_components(s, 1e6).select("component").distinct().count() == 1


def test_transforms_are_recovered(spark):
    r = np.random.default_rng(6)
    p = np.concatenate([r.normal(c, 0.05, (60, 2)) for c in ((0, 0), (1, 0.3), (0.4, 1.1))])
    df = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(p)], "index long, position_x double, position_y double")
    moved = transforms.transform_affine(df, offset=[0.3, -0.2])
    t = transforms.register_cc(moved, df, Bins.of(bin_size=0.02, bin_range=[(-1, 2)] * 2))
    assert t.offset == pytest.approx([0.3, -0.2], abs=0.02)
    m = transforms.rotation_2d(0.03)
    turned = transforms.transform_affine(df, m, [0.01, 0.02])
    icp = transforms.register_icp(df, turned, max_iteration=15)
    assert icp.matrix == pytest.approx(m, abs=1e-3) and icp.offset == pytest.approx([0.01, 0.02], abs=1e-3)
    s = transforms.standardize(df).agg(F.avg("position_x"), F.stddev_pop("position_x")).first()
    assert s[0] == pytest.approx(0, abs=1e-12) and s[1] == pytest.approx(1)
    grid = np.arange(4) + np.zeros((4, 4))
    same = transforms.unwarp(df.where("position_x > 0 and position_y > 0"), grid, grid.T, 1.0)
    assert same.agg(F.max(F.abs("position_x"))).first()[0] == pytest.approx(df.where("position_x > 0 and position_y > 0").agg(F.max("position_x")).first()[0])


def test_drift_is_recovered(spark):
    r = np.random.default_rng(7)
    base = np.concatenate([r.normal(c, 0.02, (400, 2)) for c in ((0.3, 0.3), (0.7, 0.6), (0.4, 0.8))])
    order = r.permutation(1200)
    df = spark.createDataFrame([(k, *map(float, base[q]), k) for k, q in enumerate(order)], "index long, position_x double, position_y double, frame long")
    shifted = simulate.add_drift(df, velocity=[1e-4, -5e-5])
    chunked = filters.chunks(shifted, order_by="index", n_chunks=6)
    drift = transforms.estimate_drift(chunked, Bins.of(bin_size=0.005, bin_range=[(-0.2, 1.2)] * 2))
    slope = np.polyfit([f for f, _ in drift], [t.offset[0] for _, t in drift], 1)[0]
    assert slope == pytest.approx(-1e-4, rel=0.2)
    fixed = transforms.apply_drift(shifted, drift).join(df.select("index", F.col("position_x").alias("x0")), "index")
    assert fixed.agg(F.stddev_samp(F.col("position_x") - F.col("x0"))).first()[0] < 0.01


def test_tracking(spark):
    rows = [(k, float(f), float(10 * t) + 0.1 * f, f) for k, (t, f) in enumerate((t, f) for t in range(3) for f in range(8) if not (t == 1 and f == 4))]
    df = spark.createDataFrame(rows, "index long, position_x double, position_y double, frame long")
    out, per = frames.track(df, search_range=1.5, memory=1)
    assert out.select("track").distinct().count() >= 3
    whole = frames.link(df, search_range=2.5, memory=1)
    assert whole.select("track").distinct().count() == 3 and per.count() >= 3
    assert frames.link(df, search_range=1.5, memory=0).select("track").distinct().count() == 4


def test_colocalization_of_itself(spark):
    r = np.random.default_rng(8)
    p = r.uniform(0, 1, (200, 2))
    df = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(p)], "index long, position_x double, position_y double")
    got = [x.cbc for x in spatial_stats.colocalization(df, radius=0.3, n_steps=10).collect()]
    assert len(got) == 200 and all(v is None or -1 <= v <= 1 for v in got)


def test_boundary_correction_and_hull_join(spark, points):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.5, 0.5), (2, 5.0, 0.0)], "index long, position_x double, position_y double")
    box = regions.AxisOrientedRectangle((0, 0), 10, 10)
    plain = dict(spatial_stats.local_density(df, radii=[1.0]).collect())
    cut = dict(spatial_stats.local_density(df, radii=[1.0], boundary=box).collect())
    assert cut[0] == pytest.approx(4 * plain[0], rel=1e-3) and plain[2] == cut[2] == 0
    square = spark.createDataFrame([(7, float(a), float(b)) for a in (0, 4) for b in (0, 4)] + [(8, 4.5, 4.5), (8, 6.0, 4.5), (8, 5.0, 7.0)], "cluster_label long, position_x double, position_y double")
    got = hulls.localizations_in_hulls(points, square)
    assert values(got, "index", "region_id") == [(0, 7), (2, 7), (4, 7), (5, 8)]


def test_images(spark):
    image = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 3.0), (3, 4.0)], "b0 int, value double")
    look = lambda name: [v for _, v in values(binned.transform_intensity(image, name), "b0", "value")]
    assert look("standardize") == [0, 0.25, 0.75, 1] and look("zero_uint8") == [0, 63, 191, 255] and look("none") == [0, 1, 3, 4]
    assert look("equalize_all") == pytest.approx([0.25, 0.5, 0.75, 1]) and look("equalize") == pytest.approx([0, 1 / 3, 2 / 3, 1])
    tapered = binned.apply_window(image, Bins.of(n_bins=4, bin_range=(0, 4)), alpha=1.0)
    assert [v for _, v in values(tapered, "b0", "value")][0] == 0


def test_warp_file(spark, points, tmp_path):
    rows = lambda m: "\n".join(" ".join(f"{v:.1f}" for v in line) for line in m)
    x, y = np.meshgrid(np.arange(8.0), np.arange(8.0))
    (tmp_path / "raw.txt").write_text(f"Width=8\nHeight=8\n\nX Trans -----\n{rows(x + 1)}\n\nY Trans -----\n{rows(y)}\n")
    out = transforms.bunwarp(points, str(tmp_path / "raw.txt"), 1.0)
    assert values(out, "index", "position_x", "position_y") == values(points.withColumn("position_x", F.col("position_x") + 1), "index", "position_x", "position_y")


def test_simulations(spark):
    a = simulate.simulate_uniform(spark, 300, regions.Ellipse((0, 0), 2, 1), seed=1)
    assert a.count() == 300 and filters.select_by_region(a, regions.Ellipse((0, 0), 2, 1)).count() == 300
    assert values(a, "index", "position_x") == values(simulate.simulate_uniform(spark, 300, regions.Ellipse((0, 0), 2, 1), seed=1).repartition(3), "index", "position_x")
    t = simulate.simulate_thomas(spark, 100, ((0, 1), (0, 1)), cluster_mu=10, cluster_std=0.01, clip=False, seed=2)
    mean = t.groupBy("cluster_label").count().agg(F.avg("count")).first()[0]
    assert 8 < mean < 12
    d = simulate.simulate_dstorm(spark, 200, ((0, 1), (0, 1)), cluster_mu=6, min_points=2, cluster_std=0.01, clip=False, seed=2).groupBy("cluster_label").count()
    assert d.agg(F.min("count")).first()[0] >= 2 and 5 < d.agg(F.avg("count")).first()[0] < 7
    w = simulate.simulate_tracks(spark, 3, 10, diffusion_constant=1, time_step=10, seed=1)
    steps = w.selectExpr("abs(position_x - lag(position_x) over (partition by cluster_label order by frame)) d").dropna()
    assert steps.agg(F.min("d"), F.max("d")).first() == pytest.approx((math.sqrt(40), math.sqrt(40)))
    f = simulate.simulate_frame_numbers(spark, 400, 4.0, seed=1)
    assert f.count() == 400 and 80 < f.select("frame").distinct().count() < 120


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("position_x, frame, other\n1.5, 2, z\nbad, 3.0, y\n")
    rows = text.load(spark, str(tmp_path / "a.csv"), 1).collect()
    assert [tuple(r) for r in rows] == [(1.5, 2, "z"), (None, 3, "y")]
    (tmp_path / "t.csv").write_text('"id,""frame"",""x [nm]"",""sigma [nm]"""\n1.0,2.0,3.5,4.5\n')
    t = text.load(spark, str(tmp_path / "t.csv"), "thunderstorm")
    assert t.columns == ["original_index", "frame", "position_x", "psf_sigma"] and tuple(t.first()) == (1, 2, 3.5, 4.5)
    text.save_thunderstorm_csv(t, str(tmp_path / "out"))
    assert tuple(text.load(spark, str(tmp_path / "out"), "thunderstorm").first()) == (1, 2, 3.5, 4.5)
    field = lambda *names: "".join(f'<field identifier="{n}"/>' for n in names)
    (tmp_path / "r.txt").write_text(f"# <localizations>{field('Position-0-0', 'ImageNumber-0-0', 'New')}</localizations>\n1.5 3 7\n2.5 4 8\n")
    assert [tuple(r) for r in text.load(spark, str(tmp_path / "r.txt"), 2).collect()] == [(1.5, 3, "7"), (2.5, 4, "8")]
    (tmp_path / "k.txt").write_text(f"# <localizations>{field('Position-0-0')}<localizations>{field('Position-0-0', 'ImageNumber-0-0')}</localizations></localizations>\n1.0 2 1.1 0 1.2 1\n5.0 1 5.5 9\n")
    k = text.load(spark, str(tmp_path / "k.txt"), "rapidstormtrack")
    assert values(k, "position_x", "frame") == [(1.1, 0), (1.2, 1), (5.5, 9)]
    assert text.load_rapidstorm_track(spark, str(tmp_path / "k.txt"), collection=False).count() == 2
    assert text.load_rapidstorm_track(spark, str(tmp_path / "k.txt"), min_localization_count=2).select("track").distinct().count() == 1
    (tmp_path / "e.txt").write_bytes("Index\tFirst Frame\tPosition X [nm]\r\n1\t2\t3.5\r\n2\t3\t4.5\0\r\nrest".encode("latin-1"))
    assert values(text.load(spark, str(tmp_path / "e.txt"), "elyra"), "original_index", "frame", "position_x") == [(1, 2, 3.5), (2, 3, 4.5)]
    with pytest.raises(NotImplementedError):
        text.load(spark, "x", "decode")


def test_smlm_and_native(spark, points, tmp_path):
    smlm.save_smlm(points, str(tmp_path / "a.smlm"))
    assert smlm.load_smlm_manifest(spark, str(tmp_path / "a.smlm"))["files"][0]["max"]["position_x"] == 5.0
    assert values(smlm.load_smlm(spark, str(tmp_path / "a.smlm")), "position_x", "frame") == values(points, "position_x", "frame")
    native.save_native(points, str(tmp_path / "n"), Metadata(comment="hello"))
    back = native.load_native(spark, str(tmp_path / "n"))
    assert native.metadata_of(back).comment == "hello" and values(back, "index") == values(points, "index")


def test_files(spark, tmp_path):
    for n in ("a.txt", "b.txt", "c.csv"):
        (tmp_path / n).write_text("")
    (tmp_path / "m.toml").write_text("")
    f = files.from_glob(spark, str(tmp_path))
    assert f.count() == 2 and files.concatenate([f, files.from_glob(spark, str(tmp_path), "*")]).count() == 4
    assert files.add_glob(f, str(tmp_path), "*.csv").where("other_file_path is not null").count() == 1
    g = files.set_group(f, "first", regex="a")
    assert files.grouped(g).count() >= 1 and files.summary(f).first() == (2, 2)
    assert files.match_upstream(f).where("metadata like '%m.toml'").count() == 2


def test_dataset_analysis_and_roi(spark, points, tmp_path):
    s = LocSet(points)
    t = s.transform(filters.select_by_condition, "position_x > 1").projection("position_x")
    assert t.coordinate_keys == ["position_x"] and len(t.meta.history) == 2 and t.meta.ancestor_identifiers[0] == s.meta.identifier
    assert s.select([0, 0, 3]).df.count() == 3 and s.centroid.first()[0] == pytest.approx(16 / 6)
    assert LocSet.collection([s, s]).collection_properties().count() == 2 and s.reduce().df.count() == 6
    assert LocSet.from_coordinates(spark, [[1, 2], [3, 4]]).dimension == 2
    a = Analysis(frames.localizations_per_frame).compute(points)
    assert a.results.count() == 5 and pickle.loads(pickle.dumps(a)).results is None
    p = Pipeline(lambda self, df: setattr(self, "n", df.count()), df=points).compute()
    assert p.n == 6
    roi = Roi(regions.Polygon(((0, 0), (0, 4), (4, 4))), "x")
    roi.save(str(tmp_path / "r.json"))
    assert Roi.load(str(tmp_path / "r.json")).region == roi.region and roi.select(points).count() == 1
    assert roi_from_legacy("rectangle", ((0, 0), 3, 4, 0)).select(points).count() == 2
    m = Metadata.from_toml('comment = "c"\nnew = 3').merged({"state": "modified"})
    assert (m.comment, m.state, m.extra) == ("c", "modified", {"new": "3"})


def test_stream_counts(spark, tmp_path):
    from pinprick.streaming import events

    df = spark.range(100).selectExpr("timestamp_seconds(id * 600) as ts", "id % 3 as user_id")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("c", events.counts_per_frame(stream)), ("r", events.rolling_rate(stream)), ("s", events.on_periods(stream, "user_id", "20 minutes"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() > 0
    assert spark.table("c").agg(F.max("n")).first()[0] == 6
