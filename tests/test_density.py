"""Density clusters without a list of all pairs, against all pairs."""

import numpy as np
import pytest

from pinprick.operators import clustering, density


def plain(p, eps, m):
    d = np.sqrt(sum((p[:, None, k] - p[None, :, k]) ** 2 for k in range(p.shape[1])))
    near = d <= eps
    core = near.sum(1) >= m
    label = np.where(core, np.arange(len(p)), len(p))
    while True:
        low = np.where(core, np.where(near & core[None, :], label[None, :], len(p)).min(1), len(p))
        if (low == label).all():
            break
        label = low
    label = np.where(core, label, np.where(near & core[None, :], label[None, :], len(p)).min(1))
    order = {c: k + 1 for k, c in enumerate(sorted(set(label[core].tolist())))}
    return [order.get(c, -1) for c in label.tolist()]


@pytest.mark.parametrize("axes,pairs,m", [(1, 5_000_000, 4), (2, 0, 3), (2, 5_000_000, 6), (3, 0, 4)])
def test_clusters_without_pairs(spark, monkeypatch, axes, pairs, m):
    def no_pairs(*_, **__):
        raise AssertionError("a list of all pairs within eps")

    monkeypatch.setattr(clustering, "radius_pairs", no_pairs)
    monkeypatch.setattr(density, "PAIRS", pairs)  # 0: cells are cut until each part is settled
    rng = np.random.default_rng(axes * 10 + m)
    p = np.concatenate([rng.normal(c, 0.03, (60, axes)) for c in (0, 0.25, 0.5)] + [rng.uniform(-1, 1, (40, axes))]).round(3)
    p = np.concatenate([p, p[:5], p[:5] + np.array([0.1] + [0] * (axes - 1))])
    names = ["position_x", "position_y", "position_z"][:axes]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], f"index long, {', '.join(n + ' double' for n in names)}")
    got = {r["index"]: r.cluster_label for r in clustering.dbscan(df, eps=0.1, min_samples=m).collect()}
    assert [got[i] for i in range(len(p))] == plain(p, 0.1, m)


def test_rows_without_a_place_and_far_ones(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, nan), (2, inf), (3, 0.0), (4, 0.5), (5, 1e15), (6, 1e15), (7, 9.0), (8, inf)]
    df = spark.createDataFrame(rows, "index long, position_x double")
    labels = lambda df, m: [r.cluster_label for r in clustering.dbscan(df, eps=1, min_samples=m).orderBy("index").collect()]
    assert labels(df, 2) == [-1, -1, -1, 1, 1, 2, 2, -1, -1]
    assert labels(df.where("index < 5"), 2) == [-1, -1, -1, 1, 1]
    assert labels(df.where("index < 5"), 1) == [1, 2, 3, 4, 4]
