"""Every named query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from pinprick.plans.more import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("events", "embeddings", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = []
    for row in rows:
        own = [row[k] for k in order]
        out.append(tuple(None if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in own))
    return sorted(out, key=lambda x: tuple((v is None, round(v, 5) + 0.0 if isinstance(v, float) else str(v)) for v in x))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    want = plain(cur.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(u == v or isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-6, abs_tol=1e-8) for u, v in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", ["random_subset", "cluster_hdbscan", "track", "convex_hull", "alpha_shape", "simulate_tracks", "simulate_thomas", "resample", "fit_gauss_2d"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
