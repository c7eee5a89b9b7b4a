"""Hierarchical clusters over many tasks against one task and against all levels; tracks against all assignments."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinprick.operators import clustering, frames, hierarchy


def by_levels(x, size):
    """Labels from the components at every length, by definition."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, size - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])

    def parts(w):
        left, out = set(range(n)), []
        while left:
            own, queue = set(), [min(left)]
            while queue:
                v = queue.pop()
                if v not in own:
                    own.add(v)
                    queue += [u for u in left if reach[v, u] <= w and u not in own]
            left -= own
            out.append(frozenset(own))
        return out

    levels = sorted({float(w) for w in reach[np.triu_indices(n, 1)]})
    lam = lambda w: 1 / w if w > 0 else 1e300
    clusters, alive = [], []  # [members when it is born from below, children, weight]
    for w in levels:
        now = [p for p in parts(w) if len(p) >= size]
        after = []
        for p in now:
            inside = [c for c in alive if c["all"] <= p]
            if len(inside) == 1:
                inside[0]["all"] = p
                after.append(inside[0])
            else:
                new = {"all": p, "children": inside, "fell": {}, "birth": math.inf}
                for c in inside:
                    c["birth"] = w
                clusters.append(new)
                after.append(new)
        alive = after
        for c in alive:
            for v in c["all"]:
                if not any(v in k["fell"] for k in clusters):
                    c["fell"][v] = w

    def members(c):
        return set(c["fell"]).union(*(members(k) for k in c["children"]))

    def best(c, top):
        since = 0.0 if c["birth"] == math.inf else lam(c["birth"])
        worth = sum(lam(w) - since for w in c["fell"].values()) + sum((lam(k["birth"]) - since) * len(members(k)) for k in c["children"])
        found = [best(k, False) for k in c["children"]]
        below = sum(f[0] for f in found)
        if top or (found and below > worth):
            return below, [k for f in found for k in f[1]]
        return worth, [c]

    chosen = [k for c in alive for k in best(c, True)[1]]
    out = np.full(n, -1)
    for k, m in enumerate(sorted((sorted(members(c)) for c in chosen), key=min), 1):
        out[m] = k
    return out


def some_points(seed, n=60):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(c, s, (n // 3, 2)) for c, s in (((0, 0), 0.1), ((1, 1), 0.2), ((2, 0), 0.05))] + [r.random((n // 6, 2)) * 3])


@pytest.mark.parametrize("seed", range(6))
def test_one_task_against_all_levels(seed):
    x = some_points(seed) if seed % 2 else np.random.default_rng(seed).integers(0, 9, (60, 2)).astype(float)
    for size in (3, 5):
        assert (hierarchy.labels_of(x, size) == by_levels(x, size)).all()


def spread(spark, x, size):
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double")
    got = {r.id: r.cluster_label for r in hierarchy.hierarchical_labels(df, size, False, ["x", "y"]).collect()}
    return np.array([got.get(i, -1) for i in range(len(x))])


@pytest.mark.parametrize("fit,pairs", [(200_000, 20)])
def test_many_tasks_against_one(spark, monkeypatch, fit, pairs):
    monkeypatch.setattr(hierarchy, "FIT", fit)
    monkeypatch.setattr(hierarchy, "PAIRS", pairs)
    x = np.concatenate([some_points(11, 90), np.tile([[1.0, 1.0]], (9, 1)), np.random.default_rng(1).integers(0, 3, (12, 2)) * 0.5])
    assert (spread(spark, x, 5) == hierarchy.labels_of(x, 5)).all()


def test_groups_of_any_size_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "SMALL", 50)
    x = some_points(3)
    rows = [(i, float(a), float(b), "one") for i, (a, b) in enumerate(x)] + [(1000 + i, float(a), float(b), None) for i, (a, b) in enumerate(x[:30])] + [(5000, None, 1.0, "one")]
    got = {r["index"]: r.cluster_label for r in clustering.hdbscan(spark.createDataFrame(rows, "index long, position_x double, position_y double, part string"), tile="part").collect()}
    assert [got[i] for i in range(len(x))] == hierarchy.labels_of(x).tolist()
    assert [got[1000 + i] for i in range(30)] == hierarchy.labels_of(x[:30]).tolist() and got[5000] == -1
    assert clustering.hdbscan(spark.createDataFrame([], "index long, position_x double")).count() == 0


def test_deep_trees_without_recursion():
    steps = 0.01 * 1.001 ** np.arange(1500)
    x = np.concatenate([c + np.array([[0, 0], [0.001, 0], [0, 0.001], [0.001, 0.001], [0.0005, 0.0005]]) for c in np.column_stack([np.cumsum(steps), np.zeros(1500)])])
    assert hierarchy.labels_of(x, 5).max() > 100


@pytest.mark.parametrize("seed", range(8))
def test_least_assignment(seed):
    r = np.random.default_rng(seed)
    n, m = int(r.integers(1, 5)), 6
    cost = r.random((n, m)).round(1)
    got = frames.assignment(cost)
    assert len(set(got.tolist())) == n
    assert math.isclose(cost[np.arange(n), got].sum(), min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n)))


def cost_of(old, new, links, reach):
    linked = sum(float(((np.array(old[a]) - np.array(new[b])) ** 2).sum()) for a, b in links)
    return linked + reach**2 * (len(old) - len(links))


def test_links_of_two_frames_cost_least(spark):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for t in range(12):
        old, new = r.random((4, 2)) * 3, r.random((4, 2)) * 3
        rows += [(t * 100 + k, *map(float, v), 0, t) for k, v in enumerate(old)] + [(t * 100 + 10 + k, *map(float, v), 1, t) for k, v in enumerate(new)]
        options = [[(a, b) for a, b in enumerate(p) if b >= 0] for p in itertools.product(range(-1, 4), repeat=4) if len({b for b in p if b >= 0}) == sum(b >= 0 for b in p)]
        options = [o for o in options if all(((old[a] - new[b]) ** 2).sum() <= 1 for a, b in o)]
        want[t] = (old, new, min(cost_of(old, new, o, 1) for o in options))
    df = spark.createDataFrame(rows, "index long, position_x double, position_y double, frame long, tile long")
    got = frames.link(df, search_range=1.0, tile="tile").collect()
    for t, (old, new, least) in want.items():
        mine = [x for x in got if x.tile == t]
        start = {x.track: x["index"] % 100 for x in mine if x.frame == 0}
        links = [(start[x.track], x["index"] % 100 - 10) for x in mine if x.frame == 1 and x.track in start]
        assert math.isclose(cost_of(old, new, links, 1), least)
        assert sorted({x.track for x in mine}) == list(range(8 - len(links)))


def test_greedy_would_be_longer_and_memory(spark):
    rows = [(0, 0.0, 0), (1, 1.0, 0), (2, 0.9, 1), (3, 1.9, 1), (4, 50.0, 0), (5, 50.1, 3), (6, None, 1)]
    df = spark.createDataFrame(rows, "index long, position_x double, frame long").withColumn("node", F.lit("x"))
    tracks = lambda **k: {x["index"]: x.track for x in frames.link(df, search_range=1.5, **k).collect()}
    got = tracks()
    assert got[0] == got[2] == 0 and got[1] == got[3] == 1 and got[4] == 2 and got[5] == 3 and got[6] is None
    assert tracks(memory=1)[5] == 3 and tracks(memory=2)[5] == 2
    wide = spark.createDataFrame([(0, 0.0, 0.0, 0), (1, 3.0, 0.0, 1), (2, 0.0, 3.0, 1)], "index long, position_x double, position_y double, frame long")
    assert {x["index"]: x.track for x in frames.link(wide, search_range=(4, 1)).collect()} == {0: 0, 1: 0, 2: 1}
    assert frames.link(df.limit(0)).count() == 0


def test_rounds_take_the_links_of_kruskal(spark):
    r = np.random.default_rng(7)
    rows = {tuple(sorted(map(int, r.choice(40, 2, replace=False)))): round(float(r.random()), 1) for _ in range(90)}
    edges = spark.createDataFrame([(u, v, w, u, v) for (u, v), w in rows.items()], "u long, v long, w double, a long, b long")
    take = lambda f: sorted((x.w, x.a, x.b) for x in f(edges).collect())
    assert take(hierarchy._rounds) == take(hierarchy._one_task)


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    from pinprick.operators import components

    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (8, 7), (3, 1)], "a long, b long")
    take = lambda: sorted(map(tuple, components.components(edges).collect()))
    few = take()
    monkeypatch.setattr(components, "FIT", 0)
    assert few == take() == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)]


@pytest.mark.parametrize("seed", range(4))
def test_least_transport_is_the_least_assignment_of_units(seed):
    rng = np.random.default_rng(seed)
    supply, room = rng.integers(1, 4, 5), rng.integers(1, 4, 4)
    cost = np.where(rng.random((5, 4)) < 0.6, rng.random((5, 4)), np.inf)
    flow = frames.transport(cost, supply, room)
    assert (flow.sum(1) <= supply).all() and (flow.sum(0) <= room).all() and np.isfinite(cost[flow > 0]).all()
    units = np.repeat(np.repeat(np.where(np.isinf(cost), 1e6, cost), supply, axis=0), room, axis=1)
    units = np.column_stack([units, np.ones((len(units), len(units)))])
    want = units[np.arange(len(units)), frames.assignment(units)].sum()
    assert (np.where(flow > 0, cost, 0) * flow).sum() + supply.sum() - flow.sum() == pytest.approx(want)


@pytest.mark.parametrize("memory", [0, 1])
def test_copies_of_points_are_linked_as_places(spark, monkeypatch, memory):
    seen = []
    monkeypatch.setattr(frames, "radius_pairs", lambda *a, _own=frames.radius_pairs, **k: seen.append(_own(*a, **k)) or seen[-1])
    base = [(f, float(x)) for f in range(4) for x in (0.0, 0.4, 5.0) if (f, x) != (2, 5.0)]
    rows = [(n * 100 + i, f, x) for i, (f, x) in enumerate(base) for n in range(7)]
    got = frames.link(spark.createDataFrame(rows, "index long, frame long, position_x double"), search_range=0.5, memory=memory).collect()
    pairs = sum(p.count() for p in seen)
    assert pairs < 60  # places, not the 49 times as many points
    tracks: dict[int, list] = {}
    for x in got:
        tracks.setdefault(x.track, []).append((x.frame, x.position_x))
    assert len(got) == len(rows) and all(len({f for f, _ in t}) == len(t) and len({x for _, x in t}) == 1 for t in tracks.values())
    assert len(tracks) == (21 if memory else 28) and sorted(map(len, tracks.values()))[0] == (3 if memory else 1)


def test_rounds_of_components_shrink(spark, monkeypatch):
    from pinprick.operators import components

    seen = []
    monkeypatch.setattr(components, "FIT", 100)
    monkeypatch.setattr(components, "written", lambda df, _own=components.written: seen.append(_own(df)) or seen[-1])
    n = 3000
    path = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.components(path.unionByName(path.selectExpr("a + 5000 as a", "b + 5000 as b")))
    assert {tuple(x) for x in got.collect()} == {(s + i, s) for s in (0, 5000) for i in range(n)}
    edges = [t.count() for t in seen if t.columns == ["u", "v"]]
    assert edges[-1] <= 100 and all(after <= 0.7 * before for before, after in itertools.pairwise(edges))


def test_radii_grow_fast_where_components_are_few(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(hierarchy, "_candidates", lambda *a, _own=hierarchy._candidates, **k: calls.append(a[1]) or _own(*a, **k))
    cross = np.array([[0, 0], [1, 0], [0, 1], [-1, 0], [0, -1]]) * 0.01
    x = np.concatenate([cross + [4.0**k, 0] for k in range(6)])
    assert (spread(spark, x, 5) == hierarchy.labels_of(x, 5)).all()
    assert len(calls) <= 12  # as many again when radii only doubled
