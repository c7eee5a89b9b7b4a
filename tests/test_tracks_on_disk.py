"""What tracks write and shuffle: stretches of points at places, not every point in every step."""

import glob
import os
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinprick.operators import components, frames


def kept(spark):
    roots = os.environ.get("SPARK_LOCAL_DIRS", spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir()))
    return {f for r in roots.split(",") for f in glob.glob(f"{r}/**/shuffle_*.data", recursive=True)}


def test_a_written_step_keeps_no_shuffle_files(spark):
    before = kept(spark)
    got = components.written(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3))
    end = time.time() + 10
    while (left := kept(spark) - before) and time.time() < end:
        time.sleep(0.1)
    assert not left and sorted(r["count"] for r in got.collect())[0] == 714
    assert spark.conf.get(components.CLEAN, "false") == "false"


@pytest.mark.parametrize("memory", [0, 1])
def test_chains_of_copies_are_joined_as_stretches(spark, monkeypatch, memory):
    edges, steps = [], []
    monkeypatch.setattr(frames, "components", lambda df, _own=frames.components: edges.append(df.count()) or _own(df))
    monkeypatch.setattr(frames, "written", lambda df, _own=frames.written: steps.append(_own(df)) or steps[-1])
    base = [(f, float(x)) for f in range(4) for x in (0.0, 0.4, 5.0) if (f, x) != (2, 5.0)]
    rows = [(n * 100 + i, f, x) for i, (f, x) in enumerate(base) for n in range(300)]
    got = frames.link(spark.createDataFrame(rows, "index long, frame long, position_x double"), search_range=0.5, memory=memory).collect()
    assert sum(edges) < 60  # places; the links of the 300 copies came too
    assert sum(s.count() >= len(rows) for s in steps) == 3  # ranks, beginnings and labels; places are few
    tracks: dict[int, list] = {}
    for x in got:
        tracks.setdefault(x.track, []).append((x.frame, x.position_x))
    assert len(got) == len(rows) and all(len({f for f, _ in t}) == len(t) and len({x for _, x in t}) == 1 for t in tracks.values())
    assert sorted(tracks) == list(range(900 if memory else 1200))


@pytest.mark.parametrize("seed", range(3))
def test_stretches_lead_where_every_point_leads(spark, seed):
    rng = np.random.default_rng(seed)
    n = {p: int(rng.integers(1, 700 if seed else 9)) for p in range(40)}  # eight frames of five places
    used, came, flows, back = dict.fromkeys(n, 0), dict.fromkeys(n, 0), [], {}
    for b in range(5, 40):
        for a in sorted(rng.choice(range(max(0, b // 5 * 5 - 10), b // 5 * 5), 3, replace=False).tolist()):
            k = min(int(rng.integers(0, 400 if seed else 5)), n[a] - used[a], n[b] - came[b])
            if k:
                flows.append((a, b, k, used[a], came[b]))
                back |= {(b, came[b] + i): (a, used[a] + i) for i in range(k)}
                used[a] += k
                came[b] += k
    spots = spark.createDataFrame(list(n.items()), "place long, n long")
    got = {}
    for p, u, k, q, v in map(tuple, frames._begun(spots, spark.createDataFrame(flows, "a long, b long, k long, ua long, ub long")).select("p", "u", "k", "q", "v").collect()):
        for i in range(k):
            assert (p, u + i) not in got
            got[p, u + i] = (q, v + i)
    want = {}
    for p in n:
        for u in range(n[p]):
            at = (p, u)
            while at in back:
                at = back[at]
            want[p, u] = at
    assert got == want and len({q for q in got.values()}) < len(got)


def test_sole_links_carry_the_numbers_of_copies(spark, tmp_path, capsys):
    from pinprick.plans import more

    rows = [(k, t, v) for k, (t, v) in enumerate([(0, 1.0), (1, 1.2), (0, 9.0), (0, 9.0), (1, 9.1), (0, 20.0), (1, 20.1), (1, 20.1)])]
    events = spark.createDataFrame(rows, "event_id long, hour long, value double")
    events = events.select("event_id", F.timestamp_seconds(F.col("hour") * 3600).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), "value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    out = more.QUERIES["track_sole_links"](spark, str(tmp_path))
    assert [tuple(x) for x in out.collect()] == [(0, 1)]
    capsys.readouterr()
    out.explain()
    assert capsys.readouterr().out.split("Initial Plan")[-1].count("Join") <= 5  # 9 when candidates were joined with their numbers of copies
