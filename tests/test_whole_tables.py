"""Queries without SQL that are to run over the whole table, against plain versions."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinprick.operators import clustering
from pinprick.operators.hierarchy import labels_of
from pinprick.operators.hulls import convex_hull
from pinprick.plans.catalog import QUERIES
from pinprick.plans.views import loc_emb_2d

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def test_hulls_of_all_groups(spark):
    p = loc_emb_2d(spark, SMALL).orderBy("index").collect()
    want = set()
    for label in {x.cluster_label for x in p}:
        v = convex_hull(np.array([(x.position_x, x.position_y) for x in p if x.cluster_label == label]))
        w = np.roll(v, -1, axis=0)
        want |= {(x["index"], label) for x in p if len(v) > 2 and all((w[:, 0] - v[:, 0]) * (x.position_y - v[:, 1]) - (w[:, 1] - v[:, 1]) * (x.position_x - v[:, 0]) >= 0)}
    assert {label for _, label in want} == {x.cluster_label for x in p}
    assert {(x["index"], x.region_id) for x in QUERIES["localizations_in_hulls"](spark, SMALL).collect()} == want


def test_hdbscan_of_all_points_together(spark):
    p = loc_emb_2d(spark, SMALL).orderBy("index").collect()
    want = labels_of(np.array([(x.position_x, x.position_y) for x in p]), 5)
    got = {x["index"]: x.cluster_label for x in QUERIES["cluster_hdbscan"](spark, SMALL).collect()}
    assert got == {x["index"]: k for x, k in zip(p, want.tolist())}


def test_accumulation_ends_at_all_points(spark, monkeypatch):
    monkeypatch.setattr(clustering, "dbscan", lambda df, **_: df.withColumn("cluster_label", F.lit(1)))
    total = loc_emb_2d(spark, SMALL).count()
    got = sorted(x.n for x in QUERIES["accumulation_check"](spark, SMALL).collect())
    assert got == [total * k // 10 for k in range(1, 11)]
