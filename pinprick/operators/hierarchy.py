"""Hierarchical density clusters of any number of points.

Points are linked by mutual reachability: the distance, or the larger of both core distances (to the ``size``-th
point, itself included) if that is larger. The steps, each a few joins:

1. *Spanning tree.* No link of a point is shorter than its core distance, so a point with a neighbour of a smaller core distance is linked
   to it at once. What remains is joined over growing radii, each as wide as its cells do not hold too many components. At each radius, cells that hold points of two components say
   where to look; cell pairs of very many points are cut finer, and those whose bounds rule them out go. Only the shortest link of each
   pair of components enters the next rounds. Nothing is decided beyond the radius that was searched, so the tree is exact.
2. *When a point's component reaches the cluster size*, by the shortest links of small components, in rounds. Links between two
   components that both reached it before are the splits of the tree; all others only let points fall out of a cluster.
3. *The tree of clusters* is built from the splits alone, in one task: one row for each cluster, not for each point.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, written
from .spatial import distance, nearest_neighbors

#: Links that one task orders, point pairs that are compared without cutting their cells, and points that one task clusters whole.
FIT, PAIRS, SMALL = 200_000, 1_000_000, 5_000
#: Components that a cell holds beside each, on average, unless the radius cannot be smaller; how much the radius grows where they allow it.
CROWD, GROWTH = 16, 4
_ENDLESS = 1e300


def _lam(w: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.minimum(1 / np.asarray(w, float), _ENDLESS)


# the tree of clusters

def cluster_tree(start: np.ndarray, edges: Sequence[tuple[float, int, int]]) -> tuple[np.ndarray, list[int], list[float]]:
    """Which cluster each kernel begins in, and each cluster's parent (-1: none) and the length at which it joins it.

    Kernels reach the cluster size at ``start``; ``edges`` (length, kernel, kernel) are in order. Links of one length count at once.
    """
    n = len(start)
    root, cluster, own = list(range(n)), [-1] * n, np.full(n, -1)
    parent: list[int] = []
    birth: list[float] = []

    def new() -> int:
        parent.append(-1)
        birth.append(math.inf)
        return len(parent) - 1

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    def formed(k: int, w: float) -> int:
        """The cluster of a component just below w, or -1."""
        if cluster[k] < 0 and start[k] < w:
            cluster[k] = own[k] = new()
        return cluster[k]

    for w, group in itertools.groupby(edges, key=lambda e: e[0]):
        met: dict[int, list[int]] = {}
        group = list(group)
        before = {find(k) for _, a, b in group for k in (a, b)}
        was = {k: formed(k, w) for k in before}
        for _, a, b in group:
            a, b = find(a), find(b)
            if a != b:
                root[b] = a
        for k in before:
            met.setdefault(find(k), []).append(k)
        for top, parts in met.items():
            large = sorted({was[k] for k in parts if was[k] >= 0})
            now = large[0] if len(large) == 1 else new()
            for c in large if len(large) > 1 else ():
                parent[c], birth[c] = now, w
            for k in parts:
                if was[k] < 0:
                    own[k] = now
            cluster[top] = now
    for k in range(n):
        if find(k) == k and cluster[k] < 0:
            cluster[k] = own[k] = new()
    return own, parent, birth


def chosen_clusters(parent: Sequence[int], birth: Sequence[float], count: np.ndarray, lam: np.ndarray, allow_single_cluster: bool) -> np.ndarray:
    """For each cluster the chosen one that holds it, or -1: the clusters of the largest excess of mass.

    ``count`` points fall out of a cluster, at inverse lengths that sum up to ``lam``. Children come before parents where both have been made in order of length.
    """
    n = len(parent)
    depth = np.zeros(n, int)
    order = []
    children: list[list[int]] = [[] for _ in range(n)]
    for c, p in enumerate(parent):
        if p >= 0:
            children[p].append(c)
    stack = [c for c, p in enumerate(parent) if p < 0]
    while stack:
        c = stack.pop()
        order.append(c)
        for x in children[c]:
            depth[x] = depth[c] + 1
            stack.append(x)
    size, since = np.asarray(count, float).copy(), _lam(birth)
    worth, best, keep = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    for c in reversed(order):
        worth[c] = lam[c] - count[c] * since[c]
        below = 0.0
        for x in children[c]:
            worth[c] += size[x] * (since[x] - since[c])
            size[c] += size[x]
            below += best[x]
        whole = parent[c] < 0
        keep[c] = (not children[c] or below <= worth[c]) if not whole else allow_single_cluster and (not children[c] or below <= worth[c])
        best[c] = worth[c] if keep[c] else below
    out = np.full(n, -1)
    for c in order:
        above = out[parent[c]] if parent[c] >= 0 else -1
        out[c] = above if above >= 0 else c if keep[c] else -1
    return out


# one group of points in one task

def labels_of(x: np.ndarray, size: int = 5, allow_single_cluster: bool = False) -> np.ndarray:
    """Labels of one group of points, -1 for noise, by the whole table of distances."""
    n = len(x)
    if n < size:
        return np.full(n, -1)
    core = np.empty(n)
    for i in range(0, n, 512):
        d = np.sqrt(((x[i : i + 512, None] - x[None]) ** 2).sum(2))
        core[i : i + 512] = np.partition(d, size - 1, axis=1)[:, size - 1]
    inside, best, parent = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        d = np.maximum(np.maximum(np.sqrt(((x - x[at]) ** 2).sum(1)), core), core[at])
        closer = (d < best) & ~inside
        best[closer], parent[closer] = d[closer], at
        at = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((float(best[at]), *sorted((int(parent[at]), at))))
    edges.sort()
    # as the distributed form, merged one by one: kernels, when points join them, and splits
    root, members, kernel = list(range(n)), [[v] for v in range(n)], list(range(n))
    reached, start, splits, of_root = np.full(n, np.inf), [], [], [-1] * n

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for w, a, b in edges:
        a, b = find(a), find(b)
        if of_root[a] >= 0 and of_root[b] >= 0:
            splits.append((w, of_root[a], of_root[b]))
        elif of_root[a] >= 0 or of_root[b] >= 0 or len(members[a]) + len(members[b]) >= size:
            k = max(of_root[a], of_root[b])
            if k < 0:
                k = len(start)
                start.append(w)
            for v in (members[a] if of_root[a] < 0 else []) + (members[b] if of_root[b] < 0 else []):
                reached[v], kernel[v] = w, k
            of_root[a] = of_root[b] = k
            members[a], members[b] = [], []
        if len(members[a]) < len(members[b]):
            a, b = b, a
        root[b] = a
        members[a] += members[b]
    own, parent, birth = cluster_tree(np.array(start), splits)
    fell = own[np.array(kernel)]
    for v in range(n):
        while birth[fell[v]] <= reached[v]:
            fell[v] = parent[fell[v]]
    count, lam = np.bincount(fell, minlength=len(parent)), np.bincount(fell, _lam(reached), minlength=len(parent))
    held = chosen_clusters(parent, birth, count, lam, allow_single_cluster)[fell]
    out = np.full(n, -1)
    for k, c in enumerate(dict.fromkeys(held[held >= 0].tolist()), 1):  # in order of the first member
        out[held == c] = k
    return out


# the spanning tree

def _one_task(edges: DataFrame) -> DataFrame:
    """Shortest links (u, v, w, a, b) that join the components u and v, in one task: Kruskal's rule."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(got).sort_values(["w", "a", "b"]) if (got := list(batches)) else pd.DataFrame(columns=["u", "v", "w", "a", "b"])
        root: dict[int, int] = {}

        def find(v: int) -> int:
            root.setdefault(v, v)
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        keep = []
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            u, v = find(u), find(v)
            keep.append(u != v)
            root[max(u, v)] = min(u, v)
        yield pdf[np.array(keep, bool)]

    return edges.coalesce(1).mapInPandas(run, edges.schema)


def _rounds(edges: DataFrame) -> DataFrame:
    """The same by rounds of joins: each component takes its shortest link, joined ones are one component in the next round."""
    out, now = None, edges
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "a", "b"))
        took = written(both.groupBy("u").agg(F.min(F.struct("w", "a", "b", "v")).alias("_m")).select(F.least("u", "_m.v").alias("u"), F.greatest("u", "_m.v").alias("v"), "_m.w", "_m.a", "_m.b").distinct())
        out = took if out is None else out.unionByName(took)
        names = components(took.select(F.col("u").alias("a"), F.col("v").alias("b")))
        now = _renamed(_renamed(now, "u", names), "v", names).where("u <> v")
        now = now.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.struct("w", "a", "b")).alias("_m")).select("u", "v", "_m.*")
        now = written(now)
    return edges.limit(0) if out is None else out


def _renamed(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``df`` with each component of ``column`` under its new name."""
    new = names.select(F.col("node").alias(column), F.col("component").alias("_new"))
    return df.join(new, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def _candidates(points: DataFrame, radius: float, axes: list[str], any_crowd: bool = True) -> DataFrame | None:
    """(u, v, w, a, b): the shortest link of each pair of components, of those up to ``radius``.

    None where cells hold too many components, unless ``any_crowd``."""
    d = len(axes)
    cells = [f"g{k}" for k in range(d)]
    edge = radius * 1.001
    # of points in one place, the one of the least core distance
    active = written(points.where(F.col("core") <= radius).groupBy("comp", *axes).agg(F.min(F.struct("core", "id")).alias("_m")).select("comp", *axes, "_m.core", "_m.id"))
    at = lambda level: [F.floor(F.col(x) / (edge / 2**level)).cast("long").alias(g) for x, g in zip(axes, cells)]

    def boxes(level: int) -> DataFrame:
        rows = active.select("comp", "core", *axes, *at(level))
        return written(rows.groupBy("comp", *cells).agg(F.count("*").alias("n"), F.min("core").alias("core"), *(F.min(x).alias(f"{x}_lo") for x in axes), *(F.max(x).alias(f"{x}_hi") for x in axes)))

    def side(g: DataFrame, mark: str) -> DataFrame:
        return g.select(*(F.col(c).alias(c + mark) for c in g.columns))

    steps = F.array(*(F.struct(*(F.lit(s).alias(f"s{k}") for k, s in enumerate(step))) for step in itertools.product((-1, 0, 1), repeat=d)))
    g = boxes(0)
    if not any_crowd:
        load = g.groupBy(*cells).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("n")).first()
        if load["n"] and load["pairs"] > CROWD * load["n"]:
            return None
    near = side(g, "2").withColumn("_s", F.explode(steps)).select("*", *((F.col(f"g{k}2") + F.col(f"_s.s{k}")).alias(f"g{k}1") for k in range(d))).drop("_s")
    pairs = side(g, "1").join(near, [f"g{k}1" for k in range(d)]).where("comp1 < comp2")
    found, level = None, 0
    while True:
        gap = [F.greatest(F.lit(0.0), F.col(f"{x}_lo1") - F.col(f"{x}_hi2"), F.col(f"{x}_lo2") - F.col(f"{x}_hi1")) for x in axes]
        wide = [F.greatest(F.col(f"{x}_hi1") - F.col(f"{x}_lo2"), F.col(f"{x}_hi2") - F.col(f"{x}_lo1")) for x in axes]
        pairs = pairs.withColumn("_least", F.greatest(F.sqrt(sum(x * x for x in gap)) * (1 - 1e-12), "core1", "core2")).withColumn("_most", F.greatest(F.sqrt(sum(x * x for x in wide)) * (1 + 1e-12), "core1", "core2"))
        pairs = written(pairs.where(F.col("_least") <= radius))
        bound = pairs.groupBy("comp1", "comp2").agg(F.min("_most").alias("_bound"))
        pairs = written(pairs.join(bound, ["comp1", "comp2"]).where("_least <= _bound"))
        heavy = F.col("n1") * F.col("n2") > PAIRS
        own = active.select("id", "comp", "core", *axes, *at(level))
        light = pairs.where(~heavy).select("comp1", "comp2", *(g + m for m in "12" for g in cells))
        one, two = (side(own, m) for m in "12")
        linked = light.join(one, ["comp1", *(g + "1" for g in cells)]).join(two, ["comp2", *(g + "2" for g in cells)])
        w = F.greatest(distance([F.col(x + "1") for x in axes], [F.col(x + "2") for x in axes]), "core1", "core2")
        linked = linked.select(F.col("comp1").alias("u"), F.col("comp2").alias("v"), w.alias("w"), F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).where(F.col("w") <= radius)
        linked = written(linked.groupBy("u", "v").agg(F.min(F.struct("w", "a", "b")).alias("_m")).select("u", "v", "_m.*"))
        found = linked if found is None else found.unionByName(linked)
        dense = pairs.where(heavy).select("comp1", "comp2", *(g + m for m in "12" for g in cells))
        if dense.isEmpty():
            break
        level += 1
        finer = boxes(level)
        for m in "12":
            up = side(finer, m).withColumns({f"_p{k}{m}": F.floor(F.col(f"g{k}{m}") / 2) for k in range(d)})
            dense = dense.withColumnsRenamed({f"g{k}{m}": f"_p{k}{m}" for k in range(d)}).join(up, [f"comp{m}", *(f"_p{k}{m}" for k in range(d))]).drop(*(f"_p{k}{m}" for k in range(d)))
        pairs = dense
    return found if not level else written(found.groupBy("u", "v").agg(F.min(F.struct("w", "a", "b")).alias("_m")).select("u", "v", "_m.*"))


def spanning_tree(df: DataFrame, size: int, axes: list[str]) -> DataFrame:
    """(a, b, w): a minimum spanning tree of the points (id and ``axes``) under mutual reachability, with a < b."""
    spark = df.sparkSession
    near = written(nearest_neighbors(df, k=size - 1, id_col="id", coords=axes, keep_all=True))
    core = near.where(F.col("rank") == size - 1).select("id", F.col("distance").alias("core"))
    points = written(df.join(core, "id"))
    # a neighbour of a smaller core distance: no link of this point can be shorter
    held = points.select("id", "core")
    down = near.select("id", F.col("neighbor")).join(held, "id").join(held.select(F.col("id").alias("neighbor"), F.col("core").alias("_other")), "neighbor")
    down = down.where("_other < core or (_other = core and neighbor < id)").groupBy("id", "core").agg(F.min(F.struct("_other", "neighbor")).alias("_m"))
    tree = written(down.select(F.least("id", "_m.neighbor").alias("a"), F.greatest("id", "_m.neighbor").alias("b"), F.col("core").alias("w")))
    names = components(tree.select("a", "b"))
    points = written(_renamed(points.withColumn("comp", F.col("id")), "comp", names))
    box = points.agg(*(F.max(x) - F.min(x) for x in axes)).first()
    tiny = max(math.sqrt(sum(x * x for x in box)) * 1e-9, 1e-300) if box[0] is not None else 1e-300
    radius = 0.0
    while True:
        lows = points.groupBy("comp").agg(F.min("core").alias("core"))
        least = [r["core"] for r in lows.orderBy("core").select("core").limit(2).collect()]
        if len(least) < 2:
            return tree
        floor = max(2 * radius, least[1], tiny)
        wide = max(GROWTH * radius, floor) if radius else max(lows.agg(F.percentile_approx("core", 0.5)).first()[0], floor)
        while (edges := _candidates(points, wide, axes, wide <= floor)) is None:  # halfway to the radius that is always taken
            wide = math.sqrt(wide * floor) if wide > 4 * floor else floor
        radius = wide
        many = edges.limit(FIT + 1).count()
        if not many:
            continue
        took = written(_one_task(edges)) if many <= FIT else written(_rounds(edges))
        tree = tree.unionByName(took.select("a", "b", "w"))
        points = written(_renamed(points, "comp", components(took.select(F.col("u").alias("a"), F.col("v").alias("b")), few=many <= FIT)))


# from the spanning tree to labels

def _reached(tree: DataFrame, size: int) -> DataFrame:
    """(id, w, a, b): the link by which each point's component reaches the cluster size, links of one length in order of their ends."""
    parts = tree.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    parts = written(parts.select("id", F.col("id").alias("comp")))
    done = None
    while True:
        links = tree.join(parts.withColumnsRenamed({"id": "a", "comp": "u"}), "a", "left").join(parts.withColumnsRenamed({"id": "b", "comp": "v"}), "b", "left")
        # points that have reached the size are no part of ``parts`` any more: null
        links = links.where("u is not null or v is not null").where("u is null or v is null or u <> v").withColumn("link", F.struct("w", "a", "b"))
        both = written(links.select("u", "v", "link").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "link")).where("u is not null"))
        first = both.groupBy("u").agg(F.min(F.struct("link", "v")).alias("_m")).select("u", "_m.v", "_m.link")
        first = written(first.join(parts.groupBy(F.col("comp").alias("u")).agg(F.count("*").alias("n")), "u"))
        # shortest links lead from part to part, ever shorter, to a pair that share theirs or to a large component; all parts that lead there are a group
        names = components(first.where("v is not null").select(F.col("u").alias("a"), F.col("v").alias("b")))
        grow = written(_renamed(first.withColumn("group", F.col("u")), "group", names))
        of = grow.select("u", "group")
        beside = both.join(of, "u").join(of.select(F.col("u").alias("v"), F.col("group").alias("_other")), "v", "left").where("_other is null or group <> _other")
        beside = beside.groupBy("group").agg(F.min(F.when(F.col("v").isNull(), F.col("link"))).alias("_large"), F.min(F.when(F.col("v").isNotNull(), F.col("link"))).alias("_until"))
        # a group grows in order of its links, as long as no other group is linked to it by a shorter one; a part counts one point at least
        few = grow.withColumn("_k", F.row_number().over(Window.partitionBy("group").orderBy("link", "u"))).where(F.col("_k") <= size)
        few = few.withColumn("_sum", F.sum("n").over(Window.partitionBy("group").orderBy("link").rangeBetween(Window.unboundedPreceding, 0)))
        full = few.where(F.col("_sum") >= size).groupBy("group").agg(F.min("link").alias("_full"))
        told = grow.join(full, "group", "left").join(beside, "group", "left").withColumn("_at", F.least("_full", "_large"))
        told = written(told.withColumn("_ready", F.coalesce(F.col("_at") < F.col("_until"), F.col("_at").isNotNull())))
        now = written(parts.join(told.where("_ready").select(F.col("u").alias("comp"), F.greatest("link", "_at").alias("link")), "comp").select("id", "link.w", "link.a", "link.b"))
        done = now if done is None else done.unionByName(now)
        rest = told.where("not _ready")
        joined = F.coalesce(F.col("link") <= F.col("_until"), F.lit(True))
        heads = rest.where(joined).groupBy("group").agg(F.min("u").alias("_head"))
        rest = rest.join(heads, "group").select(F.col("u").alias("comp"), F.when(joined, F.col("_head")).otherwise(F.col("u")).alias("_new"))
        rest = written(parts.join(rest, "comp").select("id", F.col("_new").alias("comp")))
        if rest.isEmpty():
            return written(done)
        parts = rest


def hierarchical_labels(df: DataFrame, size: int, allow_single_cluster: bool, axes: list[str]) -> DataFrame:
    """(id, cluster_label) of the points that are in a cluster; labels go by the smallest id."""
    tree = spanning_tree(df, size, axes)
    reached = _reached(tree, size)
    key = lambda m: reached.select(F.col("id").alias(m), F.struct("w", "a", "b").alias(f"_{m}"))
    links = written(tree.join(key("a"), "a").join(key("b"), "b").withColumn("split", (F.col("_a") < F.struct("w", "a", "b")) & (F.col("_b") < F.struct("w", "a", "b"))).select("a", "b", "w", "split"))
    names = components(links.where("not split").select("a", "b"))
    points = written(_renamed(reached.select("id", "w").withColumn("kernel", F.col("id")), "kernel", names))
    start = points.groupBy("kernel").agg(F.min("w").alias("w"))
    of = lambda m: points.select(F.col("id").alias(m), F.col("kernel").alias(f"k{m}"))
    splits = links.where("split").join(of("a"), "a").join(of("b"), "b")
    rows = start.select(F.lit(0).alias("_one"), F.col("w"), F.col("kernel").alias("ka"), F.lit(None).cast("long").alias("kb")).unionByName(splits.select(F.lit(0).alias("_one"), "w", "ka", "kb"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[pdf["kb"].isna()].sort_values("ka")
        name = first["ka"].to_numpy()
        more = pdf[pdf["kb"].notna()].sort_values("w")
        a, b = (np.searchsorted(name, more[c].to_numpy(np.int64)) for c in ("ka", "kb"))
        own, parent, birth = cluster_tree(first["w"].to_numpy(), list(zip(more["w"].tolist(), a.tolist(), b.tolist())))
        kernels = pd.DataFrame({"kernel": name, "cluster": own, "parent": -1, "birth": 0.0})
        return pd.concat([kernels, pd.DataFrame({"kernel": pd.array([None] * len(parent), "Int64"), "cluster": np.arange(len(parent)), "parent": parent, "birth": birth})])

    told = written(rows.groupBy("_one").applyInPandas(build, "kernel long, cluster long, parent long, birth double"))
    clusters = told.where("kernel is null").select("cluster", "parent", "birth")
    now = written(points.join(told.where("kernel is not null").select("kernel", "cluster"), "kernel").select("id", "w", "cluster"))
    # the cluster that a point falls out of: the first ancestor that lasts beyond its link, by jumps of halving length
    jumps = [written(clusters.where("parent >= 0").select("cluster", F.col("parent").alias("to"), "birth"))]
    while not (nxt := written(jumps[-1].alias("x").join(jumps[-1].alias("y"), F.col("x.to") == F.col("y.cluster")).select(F.col("x.cluster").alias("cluster"), F.col("y.to").alias("to"), F.col("y.birth").alias("birth")))).isEmpty():
        jumps.append(nxt)  # birth: of the last cluster that is left behind
    for j in reversed(jumps):
        now = now.join(j, "cluster", "left").withColumn("cluster", F.when(F.col("birth") <= F.col("w"), F.col("to")).otherwise(F.col("cluster"))).select("id", "w", "cluster")
    now = written(now)
    lam = F.least(F.when(F.col("w") > 0, 1 / F.col("w")).otherwise(_ENDLESS), F.lit(_ENDLESS))
    sums = now.groupBy("cluster").agg(F.count("*").alias("count"), F.sum(lam).alias("lam"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster").fillna({"count": 0, "lam": 0.0})
        held = chosen_clusters(pdf["parent"].tolist(), pdf["birth"].tolist(), pdf["count"].to_numpy(), pdf["lam"].to_numpy(), allow_single_cluster)
        return pd.DataFrame({"cluster": pdf["cluster"], "chosen": held})[held >= 0]

    chosen = clusters.join(sums, "cluster", "left").withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(choose, "cluster long, chosen long")
    member = written(now.join(chosen, "cluster").select("id", "chosen"))
    firsts = member.groupBy("chosen").agg(F.min("id").alias("_first"))
    from .filters import numbered_rows

    number = numbered_rows(firsts, [F.col("_first")], "cluster_label").withColumn("cluster_label", F.col("cluster_label") + 1)
    return member.join(number.select("chosen", "cluster_label"), "chosen").select("id", "cluster_label")
