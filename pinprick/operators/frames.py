"""Operators along time: counts per frame, on and off periods, next-frame matches, tracks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import coordinates
from .components import components, written
from .filters import numbered_rows
from .spatial import radius_pairs


def localization_property(df: DataFrame, name: str = "intensity", index: str | None = None) -> DataFrame:
    """One property, along an index column and in its order if given."""
    return df.select(name) if index is None else df.select(index, name).orderBy(index)


def localizations_per_frame(df: DataFrame, *, norm: float | None = None, by: Sequence[str] = (), frame: str = "frame") -> DataFrame:
    """Count per frame that occurs, over ``norm`` if given."""
    out = df.groupBy(*by, frame).agg(F.count("*").alias("n"))
    return out.withColumn("n", F.col("n") / norm) if norm else out


def resampled(counts: DataFrame, width: int, frame: str = "frame") -> DataFrame:
    """Sums of ``n`` over stretches of ``width`` frames."""
    return counts.groupBy((F.floor(F.col(frame) / width) * width).cast("long").alias(frame)).agg(F.sum("n").alias("n"))


def cumulative_share(counts: DataFrame, frame: str = "frame") -> DataFrame:
    """Add the share of all rows up to each frame. Counts are one row per frame, so one ordered pass over them is short."""
    return counts.withColumn("share", F.sum("n").over(Window.orderBy(frame)) / F.sum("n").over(Window.partitionBy(F.lit(1))))


def accumulation_time(counts: DataFrame, fraction: float = 0.5, frame: str = "frame") -> DataFrame:
    """First frame at which more than ``fraction`` of all rows have come."""
    return cumulative_share(counts, frame).where(F.col("share") > fraction).agg(F.min(frame).alias("accumulation_time"))


def _frames(df: DataFrame, by: Sequence[str], frame: str) -> DataFrame:
    return df.select(*by, F.col(frame).cast("long").alias("frame")).dropna().distinct()


def on_periods(df: DataFrame, *, memory: int = 0, remove_heading_off_periods: bool = True, by: Sequence[str] = (), frame: str = "frame") -> DataFrame:
    """(by, frame, period, n_frames): runs of frames, gaps of at most ``memory`` frames bridged, from their first frame.

    Repeated frames count once. A first run that begins within ``memory`` frames of frame 0 is taken to begin there
    unless heading off periods are removed.
    """
    w = Window.partitionBy(*by).orderBy("frame")
    gap = F.col("frame") - F.lag("frame", 1, -1).over(w)
    rows = _frames(df, by, frame).withColumn("_new", (gap > memory + 1).cast("int")).withColumn("_run", F.sum("_new").over(w))
    out = rows.groupBy(*by, "_run").agg(F.min("frame").alias("frame"), F.max("frame").alias("_last"), F.count("*").alias("n_frames"))
    if not remove_heading_off_periods:
        out = out.withColumn("frame", F.when((F.col("_run") == 0), F.lit(0)).otherwise(F.col("frame")))
    return out.select(*by, "frame", (F.col("_last") - F.col("frame") + 1).alias("period"), "n_frames")


def off_periods(df: DataFrame, *, memory: int = 0, remove_heading_off_periods: bool = True, by: Sequence[str] = (), frame: str = "frame") -> DataFrame:
    """(by, frame, period): gaps of more than ``memory`` frames between frames that occur, from their first frame."""
    w = Window.partitionBy(*by).orderBy("frame")
    rows = _frames(df, by, frame).withColumn("_before", F.lag("frame", 1, -1).over(w))
    out = rows.where(F.col("frame") - F.col("_before") > memory + 1)
    if remove_heading_off_periods:
        out = out.where("_before >= 0")
    return out.select(*by, (F.col("_before") + 1).alias("frame"), (F.col("frame") - F.col("_before") - 1).alias("period"))


def places(df: DataFrame, at: Sequence[str], id_col: str = "index") -> DataFrame:
    """(``at``, id, n): each place with the smallest id of the rows there and their number."""
    return df.groupBy(*at).agg(F.min(id_col).alias(id_col), F.count("*").alias("n"))


def localization_precision(df: DataFrame, *, radius: float = 50, id_col: str = "index", by: Sequence[str] = (), inclusive: bool = False) -> DataFrame:
    """Each point matched to the nearest within ``radius`` in the next frame, with the differences.

    An equi-join on frame and cell, of places: rows of one frame at one place have one match, and of those matched the smallest id stands for the rest. The last pair of frames is left out unless ``inclusive``. Ties go to the smaller id.
    """
    coords = coordinates(df.columns)
    spot = ["frame", *by, *coords]
    at = places(df.dropna(subset=coords), spot, id_col)
    first = at.withColumn("_f", F.col("frame"))
    if not inclusive:
        top = df.agg((F.max("frame") - 1).alias("_top"))
        first = first.crossJoin(F.broadcast(top)).where("_f < _top").drop("_top")  # one row is broadcast
    second = at.withColumn("_f", F.col("frame") - 1)
    pairs = radius_pairs(first, second, radius=radius, id_col=id_col, coords=coords, on=["_f", *by])
    best = pairs.groupBy("id1").agg(F.min(F.struct("distance", "id2")).alias("m")).select(F.col("id1").alias(id_col), F.col("m.id2").alias("_other"), F.col("m.distance").alias("position_distance"))
    b = at.select(F.col(id_col).alias("_other"), *(F.col(c).alias(f"__{c}") for c in coords))
    best = best.join(at.select(id_col, *spot), id_col).drop(id_col).join(b, "_other")
    out = df.select(id_col, *spot).join(best, spot)
    return out.select(F.col(id_col).alias("original_index"), *by, "frame", *((F.col(c) - F.col(f"__{c}")).alias(f"position_delta_{c[-1]}") for c in coords), "position_distance")


def assignment(cost: np.ndarray) -> np.ndarray:
    """For each row of a cost table of no more rows than columns its column, all different, at the least total cost (shortest augmenting paths)."""
    n, m = cost.shape
    u, v, row_of = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        row_of[m], at = i, m
        least, before, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while row_of[at] >= 0:
            done[at] = True
            r = row_of[at]
            now = cost[r] - u[r] - v[:m]
            closer = ~done[:m] & (now < least)
            least[closer], before[closer] = now[closer], at
            j = int(np.argmin(np.where(done[:m], np.inf, least)))
            step = least[j]
            u[row_of[done]] += step
            v[done] -= step
            least[~done[:m]] -= step
            at = j
        while at != m:
            row_of[at], at = row_of[before[at]], before[at]
    out = np.empty(n, int)
    held = row_of[:m] >= 0
    out[row_of[:m][held]] = np.flatnonzero(held)
    return out


def transport(cost: np.ndarray, supply: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Units from each row to each column of a cost table at the least total cost (shortest augmenting paths).

    A row gives at most ``supply`` units, each unit that it keeps costs 1, and a column takes at most ``room``. Endless costs are never used."""
    n, m = cost.shape
    c = np.column_stack([cost, np.ones(n)])
    free = np.append(room, supply.sum())
    flow, u, v = np.zeros((n, m + 1), int), np.zeros(n), np.zeros(m + 1)
    for i in range(n):
        left = int(supply[i])
        while left:
            least, before, done = np.full(m + 1, np.inf), np.full(m + 1, i), np.zeros(m + 1, bool)
            at, via = np.full(n, np.inf), np.full(n, -1)
            at[i], d, rows = 0.0, 0.0, [i]
            while True:
                for r in rows:
                    now = d + c[r] - u[r] - v
                    closer = ~done & (now < least)
                    least[closer], before[closer] = now[closer], r
                j = int(np.argmin(np.where(done, np.inf, least)))
                d = least[j]
                done[j] = True
                if free[j]:
                    break
                rows = np.flatnonzero((flow[:, j] > 0) & np.isinf(at)).tolist()
                at[rows], via[rows] = d, j
            seen = np.isfinite(at)
            u[seen] += d - at[seen]
            v[done] -= d - least[done]
            path, col = [], j
            while (r := int(before[col])) != i:
                path.append((r, col))
                col = int(via[r])
            k = min(left, int(free[j]), *(int(flow[r, via[r]]) for r, _ in path))
            free[j] -= k
            left -= k
            flow[i, col] += k
            for r, to in path:
                flow[r, to] += k
                flow[r, via[r]] -= k
    return flow[:, :m]


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Numbers of links (a, b, k) among the candidates (a, b, fb, d2, na, nb) of some places, na and nb being their points: frame by frame, each subnet
    at the least sum of squared distances, where an open point that is not linked counts as the square of the range, 1."""
    taken: dict[int, int] = {}
    out: list[tuple[int, int, int]] = []
    for _, now in pdf.sort_values(["fb", "a", "b"]).groupby("fb", sort=True):
        root: dict[tuple[int, int], tuple[int, int]] = {}

        def find(x: tuple[int, int]) -> tuple[int, int]:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        edges = [(a, b, d, na - taken.get(a, 0), nb) for a, b, d, na, nb in zip(*(now[c].tolist() for c in ("a", "b", "d2", "na", "nb")))]
        edges = [e for e in edges if e[3]]
        for x, y, *_ in edges:
            root[find((0, x))] = find((1, y))
        nets: dict[tuple[int, int], list[tuple[int, int, float, int, int]]] = {}
        for e in edges:
            nets.setdefault(find((0, e[0])), []).append(e)
        for net in nets.values():
            if len(net) == 1:
                chosen = [(*net[0][:2], min(net[0][3:]))]
            else:
                a, b = sorted({(x, n) for x, _, _, n, _ in net}), sorted({(y, n) for _, y, _, _, n in net})
                row, column = {x: i for i, (x, _) in enumerate(a)}, {y: j for j, (y, _) in enumerate(b)}
                cost = np.full((len(a), len(b)), np.inf)
                for x, y, d, *_ in net:
                    cost[row[x], column[y]] = d
                flow = transport(cost, np.array([n for _, n in a]), np.array([n for _, n in b]))
                chosen = [(a[i][0], b[j][0], int(flow[i, j])) for i, j in zip(*(x.tolist() for x in np.nonzero(flow)))]
            out += chosen
            for x, _, k in chosen:
                taken[x] = taken.get(x, 0) + k
    return pd.DataFrame(out, columns=["a", "b", "k"])


#: Ranks of a place that meet the stretches among them in one join key.
SHARE = 256


def _begun(spots: DataFrame, flows: DataFrame) -> DataFrame:
    """(p, u, k, q, v): the points u to u + k - 1 of place p lie on the tracks that begin with the points of place q from v on, in this order.

    Links of flows (a, b, k, ua, ub) go from the points of a from ua on to those of b from ub on. Stretches of points, not points, follow them, twice as far in each
    round; a stretch whose points come from several is cut. Points that nothing is linked to begin a track."""
    held = flows.groupBy(F.col("b").alias("place")).agg(F.sum("k").alias("_in"))
    own = spots.join(held, "place", "left").withColumn("u", F.coalesce("_in", F.lit(0).cast("long"))).where("u < n")
    done = own.select(F.col("place").alias("p"), "u", (F.col("n") - F.col("u")).alias("k"), F.col("place").alias("q"), F.col("u").alias("v"))
    done = written(done.withColumn("done", F.lit(True)))
    left = flows.select(F.col("b").alias("p"), F.col("ub").alias("u"), "k", F.col("a").alias("q"), F.col("ua").alias("v"), F.lit(False).alias("done"))
    low, high = F.greatest("v", "u2"), F.least(F.col("v") + F.col("k"), F.col("u2") + F.col("k2"))
    while not left.isEmpty():
        at = done.unionByName(left).select(F.col("p").alias("q"), *(F.col(c).alias(f"{c}2") for c in ("u", "k", "q", "v", "done")))
        both = left.drop("done").join(at, "q").where(low < high)
        now = both.select("p", (F.col("u") + low - F.col("v")).alias("u"), (high - low).alias("k"), F.col("q2").alias("q"), (F.col("v2") + low - F.col("u2")).alias("v"), F.col("done2").alias("done"))
        now = written(now)
        done, left = done.unionByName(now.where("done")), now.where("not done")
    return done.drop("done")


def link(df: DataFrame, *, search_range: float | Sequence[float] = 40, memory: int = 0, tile: str | None = None, id_col: str = "index") -> DataFrame:
    """Add ``track``: points of successive frames linked so that the sum of squared distances is least.

    Points of successive frames within ``search_range`` (one number, or one for each axis) are candidates. Candidates that share points form subnets, and each subnet is linked at the
    least sum of squared distances, an unlinked point counting as the range. A point without a successor stays open for
    ``memory`` more frames. Subnets are found by joins and solved side by side: without memory those of two frames each, with memory all that hang together in space and time,
    which then have to fit a task. Points of one frame at one place are one row with a count there, and so are candidates and links, until the links are chosen. Points of different ``tile`` are never linked. Tracks are numbered from 0, within the tile, by first frame and smallest id.
    Rows with a null coordinate, frame or id have no track. Ids are unique integers.
    """
    coords = coordinates(df.columns)
    ranges = [float(search_range)] * len(coords) if isinstance(search_range, (int, float)) else [float(x) for x in search_range]
    if len(ranges) != len(coords) or min(ranges) <= 0:
        raise ValueError("search_range is one positive number, or one for each coordinate")
    axes = [f"_x{k}" for k in range(len(coords))]
    points = df.select(F.col(id_col).cast("long").alias("id"), F.col("frame").cast("long").alias("f"), (F.col(tile) if tile else F.lit(0)).alias("t"), *((F.col(c) / r).alias(x) for c, r, x in zip(coords, ranges, axes)))
    points = points.dropna(subset=["id", "f", *axes])
    here = Window.partitionBy("t", "f", *axes).orderBy("id")
    ranked = written(points.withColumns({"place": F.first("id").over(here), "rank": F.row_number().over(here) - 1}))
    spots = written(ranked.groupBy("place").agg(F.first("f").alias("f"), F.first("t").alias("t"), *(F.first(x).alias(x) for x in axes), F.count("*").alias("n")))
    spots = spots.withColumn("spot", F.struct("place", "f", "n"))
    pairs = None
    for gap in range(1, memory + 2):
        own = radius_pairs(spots.withColumn("f", F.col("f") + gap), spots, radius=1, id_col="spot", coords=axes, on=["t", "f"])
        pairs = own if pairs is None else pairs.unionByName(own)
    ends = [F.col(f"id{k}.{x}").alias(c) for k, x, c in ((1, "place", "a"), (2, "place", "b"), (1, "n", "na"), (2, "n", "nb"), (2, "f", "fb"))]
    pairs = written(pairs.select(*ends, (F.col("distance") * F.col("distance")).alias("d2")))
    # a place as the end of one link and the start of the next is in two subnets, unless open points tie them together
    start, end = (F.col("a") * 2, F.col("b") * 2 + 1) if memory == 0 else (F.col("a"), F.col("b"))
    nets = components(pairs.select(start.alias("a"), end.alias("b")))
    rows = pairs.withColumn("node", start).join(nets, "node").select("component", "a", "b", "fb", "d2", "na", "nb")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work
    flows = rows.repartition(tasks, "component").groupBy("component").applyInPandas(lambda pdf: _linked(pdf), "a long, b long, k long")
    before = lambda c, other: F.sum("k").over(Window.partitionBy(c).orderBy(other)) - F.col("k")
    begun = _begun(spots, written(flows.withColumns({"ua": before("a", "b"), "ub": before("b", "a")})))
    cut = lambda c: F.floor(c / SHARE).cast("long")
    begun = begun.withColumn("_cut", F.explode(F.sequence(cut(F.col("u")), cut(F.col("u") + F.col("k") - 1))))
    owned = ranked.withColumn("_cut", cut(F.col("rank"))).join(begun.withColumnRenamed("p", "place"), ["place", "_cut"]).where("rank >= u and rank < u + k")
    owned = written(owned.select("id", "f", "t", "q", (F.col("v") + F.col("rank") - F.col("u")).alias("r"), (F.col("q") == F.col("place")).alias("first")))
    number = written(numbered_rows(owned.where("first").drop("first"), [F.col("t"), F.col("f"), F.col("id")], "_n").select("t", "q", "r", "_n"))
    begin = number.groupBy(F.col("t").alias("_t")).agg(F.min("_n").alias("_begin"))
    named = number.join(begin, F.col("t").eqNullSafe(F.col("_t"))).select("q", "r", (F.col("_n") - F.col("_begin")).alias("track"))
    labels = written(owned.select("id", "q", "r").join(named, ["q", "r"]).select(F.col("id").alias("_id"), "track"))
    return df.drop("track").join(labels, F.col(id_col).cast("long") == F.col("_id"), "left").drop("_id")


def track(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The linked rows and one row of properties per track."""
    from .properties import collection_properties

    rows = link(df, **options)
    return rows, collection_properties(rows, [options["tile"], "track"] if options.get("tile") else "track")


def uncertainty(df: DataFrame, model: int = 1, *, pixel_size: float | None = None) -> DataFrame:
    """Localization uncertainty from photons N, width s, pixel size a and background b.

    Model 1: 1/sqrt(N). Model 2: s/sqrt(N). Model 3: sqrt((s^2 + a^2/12)/N (1 + 4t + sqrt(2t/(1 + 4t)))) with
    t = 2 pi b (s^2 + a^2/12)/(N a^2). Widths along each axis give one column per axis.
    """
    n = F.col("intensity")
    if model == 1:
        return df.withColumn("uncertainty", 1 / F.sqrt(n))
    names = [s for s in ("psf_sigma", "psf_sigma_x", "psf_sigma_y", "psf_sigma_z") if s in df.columns]
    out = {}
    for s in names:
        s2 = F.col(s) * F.col(s)
        if model == 2:
            value = F.col(s) / F.sqrt(n)
        elif model == 3:
            sa = s2 + pixel_size * pixel_size / 12
            t = 2 * np.pi * F.col("local_background") * sa / (n * pixel_size * pixel_size)
            value = F.sqrt(sa / n * (1 + 4 * t + F.sqrt(2 * t / (1 + 4 * t))))
        else:
            raise ValueError("model is 1, 2 or 3")
        out["uncertainty" + s.removeprefix("psf_sigma")] = value
    return df.withColumns(out)


def subpixel_bias(df: DataFrame, pixel_size: float | Sequence[float]) -> DataFrame:
    """``<coordinate>_modulo``: what is left of the coordinate beyond whole pixels, with the pixel's sign."""
    coords = coordinates(df.columns)
    sizes = [pixel_size] * len(coords) if isinstance(pixel_size, (int, float)) else list(pixel_size)
    return df.withColumns({f"{c}_modulo": F.pmod(F.col(c), F.lit(float(p))) for c, p in zip(coords, sizes)})

