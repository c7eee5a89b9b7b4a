"""Nearest neighbours where density is very uneven: a far outlier, many rows at one place, clusters within clusters."""

import numpy as np
import pytest

from pinprick.operators import spatial


def frame_of(spark, p, first=0):
    return spark.createDataFrame([(first + k, float(x), float(y)) for k, (x, y) in enumerate(p)], "index long, position_x double, position_y double").repartition(4)


def by_brute_force(p, q, k, same):
    out = {}
    for i, a in enumerate(p):
        d = np.sqrt(((q - a) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(q)), d)) if not (same and i == j)][:k]
        out[i] = [(j, d[j]) for j in order] if len(order) == k else []
    return out


r = np.random.default_rng(8)
CASES = {
    "outlier": np.vstack([r.normal(0, 1, (600, 2)), [[1e6, -1e6]]]),
    "one place": np.vstack([np.full((500, 2), 3.0), r.uniform(0, 10, (100, 2))]),
    "nested": np.vstack([r.normal(0, 1e-6, (300, 2)), r.normal(5, 1e-3, (200, 2)), r.uniform(-100, 100, (100, 2))]),
}


@pytest.mark.parametrize("name, k, jump", [("outlier", 1, 5_000_000), ("one place", 1, 5_000_000), ("one place", 3, 5_000_000), ("nested", 3, 100_000)])
def test_the_nearest_are_found(spark, monkeypatch, name, k, jump):
    monkeypatch.setattr(spatial, "JUMP", jump)
    p = CASES[name]
    for same in (True, False):
        q = p if same else p[::3]
        df, other = frame_of(spark, p), None if same else frame_of(spark, q)
        got = {}
        for x in spatial.nearest_neighbors(df, other, k=k, keep_all=True).collect():
            got.setdefault(x["index"], []).append((x["rank"], x["neighbor"], x["distance"]))
        want = by_brute_force(p, q, k, same)
        assert set(got) == {i for i, v in want.items() if v}
        for i, rows in got.items():
            rows.sort()
            assert [n for _, n, _ in rows] == [j for j, _ in want[i]]
            assert np.allclose([d for *_, d in rows], [d for _, d in want[i]], rtol=1e-9, atol=1e-12)


def test_a_far_outlier_does_not_make_all_pairs(spark):
    p = np.vstack([np.random.default_rng(1).uniform(0, 1, (20_000, 2)), [[1e5, 1e5]]])
    df = frame_of(spark, p)
    radius, target = spatial._first_search(df, df, True, ["position_x", "position_y"], "index", 1, 1.5 * 1e5 / 20_000**0.5, len(p))
    assert radius < 0.05 and target.count() == len(p)
    assert spatial.radius_pairs(df, radius=radius).count() < 40 * spatial.CROWD * len(p) < len(p) ** 2 / 20
    got = spatial.nearest_neighbors(df).where("index = 20000").first()
    assert got["distance"] == pytest.approx(np.sqrt(((p[:-1] - p[-1]) ** 2).sum(1)).min())
