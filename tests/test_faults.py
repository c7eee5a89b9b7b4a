"""Cases that once gave wrong answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinprick.functions.binning import Bins, edges_from_size
from pinprick.operators import clustering, filters, hulls, properties, spatial, transforms
from pinprick.sources import text


def test_points_at_the_radius_meet(spark):
    df = spark.createDataFrame([(0, -1e-18), (1, 0.1)], "index long, position_x double")
    assert spatial.radius_pairs(df, radius=0.1).count() == 2
    for x in (0.3, 1e6, 1e9):
        df = spark.createDataFrame([(k, x + 0.1 * k) for k in range(50)], "index long, position_x double")
        full = spatial.pair_distances(df).where("pair_distance <= 0.1").count()
        assert spatial.radius_pairs(df, radius=0.1).count() == 2 * full


def test_one_bin_larger_than_the_range():
    assert edges_from_size(10, 0, 5) == [0, 5] and edges_from_size(10, 0, 5, True) == [0, 10] and edges_from_size([10, 1], 0, 5) == [0, 5]
    assert Bins.of(bin_size=10, bin_range=(0, 5)).is_equally_sized == (True,)


def test_flip_mirrors_once_and_the_grid_ends(spark, tmp_path):
    w, h = 4, 3
    rows = lambda f: "\n".join(" ".join(str(float(f(i, j))) for i in range(w)) for j in range(h))
    path = tmp_path / "identity.txt"
    path.write_text(f"Width={w}\nHeight={h}\n\nX Trans -----\n{rows(lambda i, j: i)}\n\nY Trans -----\n{rows(lambda i, j: j)}\n")
    df = spark.createDataFrame([(0, 1.0, 1.5)], "index long, position_x double, position_y double")
    assert tuple(transforms.bunwarp(df, str(path), 1.0, flip=True).first())[1:] == pytest.approx((3.0, 1.5))
    assert tuple(transforms.bunwarp(df, str(path), 1.0).first())[1:] == pytest.approx((1.0, 1.5))
    with pytest.raises(Exception, match="outside the grid"):
        transforms.bunwarp(df.withColumn("position_x", F.lit(7.0)), str(path), 1.0).collect()


def test_concat_numbers_rows(spark):
    a = spark.createDataFrame([(5, 1.0), (2, 2.0)], "index long, position_x double")
    got = filters.concat([a, a.drop("index"), a]).orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(6)) and [r.position_x for r in got[:2]] == [2.0, 1.0]


def test_large_integers_keep_their_digits(spark):
    df = spark.createDataFrame([("9007199254740993",), (" 12.0 ",), ("x",), ("-3",)], "frame string")
    assert [r[0] for r in text.convert_property_types(df).collect()] == [9007199254740993, 12, None, -3]


def test_median_by_ranks(spark):
    r = np.random.default_rng(1)
    for n in (1, 2, 9, 1000):
        v = r.normal(size=n).tolist()
        df = spark.createDataFrame([(x, None if k == 0 and n > 2 else x) for k, x in enumerate(v)], "a double, b double").repartition(5)
        got = properties.statistics(df, ["a", "b"], ["median", "count"]).first()
        assert got.a_median == pytest.approx(np.median(v)) and got.b_median == pytest.approx(np.median(v[1:] if n > 2 else v)) and got.a_count == n
    assert properties.statistics(df.limit(0), ["a"], ["median", "count"]).first().a_median is None


def test_clusters_are_numbered_by_their_smallest_member(spark):
    df = spark.createDataFrame([(100 - k, 10.0 * (k // 5) + 0.1 * (k % 5)) for k in range(60)], "index long, position_x double")
    got = {r["index"]: r.cluster_label for r in clustering.dbscan(df, eps=1, min_samples=3).collect()}
    assert [got[41 + 5 * k] for k in range(12)] == list(range(1, 13))


def test_points_in_oriented_boxes(spark):
    turn = transforms.rotation_2d(0.5)
    corners = (np.array([[0, 0], [4, 0], [4, 1], [0, 1], [2, 0.5]]) @ turn.T).tolist()
    group = spark.createDataFrame([(k, *p, 1) for k, p in enumerate(corners)], "index long, position_x double, position_y double, cluster_label int")
    probes = (np.array([[1, 0.5], [3.9, 0.9], [4.1, 0.5], [2, 1.1], [-0.1, 0]]) @ turn.T).tolist()
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(probes)], "index long, position_x double, position_y double")
    assert {r["index"] for r in hulls.localizations_in_hulls(df, group, hull="oriented_bounding_box").collect()} == {0, 1}


def test_next_frame_matches_of_copies_are_searched_once(spark, monkeypatch):
    from pinprick.operators import frames

    seen = []
    monkeypatch.setattr(frames, "radius_pairs", lambda *a, _own=frames.radius_pairs, **k: seen.append(_own(*a, **k)) or seen[-1])
    rows = [(10 * i + n, f, x, "u") for i, (f, x) in enumerate([(0, 0.0), (0, 3.0), (1, 1.0), (1, -1.0), (2, 9.0), (3, 0.0)]) for n in range(9, -1, -1)]
    df = spark.createDataFrame([*rows, (900, 0, None, "u"), (901, 0, 0.0, None)], "index long, frame long, position_x double, channel string")
    got = sorted((r.original_index, r.position_delta_x, r.position_distance) for r in frames.localization_precision(df, radius=2, by=["channel"]).collect())
    assert got == [(n, -1.0, 1.0) for n in range(10)] + [(10 + n, 2.0, 2.0) for n in range(10)]
    assert seen[0].count() == 3  # of places; 300 of rows
