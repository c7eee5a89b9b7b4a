"""Seeded point processes. Every random number is a hash of the seed, the row's number and a name, so results
do not depend on partitioning, retries or the number of executors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import COORDINATES, coordinates
from ..functions.regions import Polygon, Region, region_from_intervals


def uniform(seed: int, name: str, *keys: Column) -> Column:
    """A number in (0, 1) per key."""
    h = F.xxhash64(F.lit(seed), F.lit(name), *keys)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, name: str, *keys: Column) -> Column:
    """A standard normal number per key, from two uniform ones."""
    return F.sqrt(-2 * F.ln(uniform(seed, name + "/r", *keys))) * F.cos(2 * math.pi * uniform(seed, name + "/a", *keys))


def poisson(mean: float, u: Column) -> Column:
    """A Poisson number per uniform one, by the table of its distribution function."""
    top, p, total, cdf = int(mean + 12 * math.sqrt(mean) + 20), math.exp(-mean) if mean < 700 else None, 0.0, []
    if p is None:  # large means: the nearest normal number
        return F.greatest(F.lit(0), F.round(mean + math.sqrt(mean) * F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * F.pmod(u * 7919, F.lit(1.0))))).cast("int")
    for k in range(top):
        total += p
        cdf.append(total)
        p *= mean / (k + 1)
    return F.size(F.filter(F.array(*(F.lit(c) for c in cdf)), lambda c: c < u))


def _region(region) -> Region:
    if isinstance(region, Region):
        return region
    return region_from_intervals([region] if isinstance(region[0], (int, float)) else region)


def simulate_uniform(spark: SparkSession, n: int, region=(0, 1), seed: int = 0) -> DataFrame:
    """n uniform points of the region; a region that does not fill its box is filled by rejection, in rounds
    of as many candidates as the missing share needs."""
    r = _region(region)
    names, out, have, done = COORDINATES[: r.dimension], None, 0, 0
    share = max(min(r.region_measure / math.prod(r.extent), 1.0), 1e-6)
    while have < n:
        more = int((n - have) / share * 1.1) + 10
        rows = spark.range(done, done + more)
        done += more
        rows = rows.select("id", *((F.lit(lo) + uniform(seed, c, F.col("id")) * (hi - lo)).alias(c) for c, (lo, hi) in zip(names, r.bounds)))
        rows = rows.where(r.contains([F.col(c) for c in names]))
        have += rows.count()
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "index long" + "".join(f", {c} double" for c in names))
    return out.orderBy("id").limit(n).withColumnRenamed("id", "index")


def simulate_poisson(spark: SparkSession, intensity: float, region=(0, 1), seed: int = 0) -> DataFrame:
    """Uniform points, as many as a Poisson number of mean intensity times measure."""
    r = _region(region)
    return simulate_uniform(spark, int(np.random.default_rng(seed).poisson(intensity * r.region_measure)), r, seed)


def _grown(region: Region, by: float) -> Region:
    return region_from_intervals([(lo - by, hi + by) for lo, hi in region.bounds])


def simulate_cluster(parents: DataFrame, count: Column, step: Sequence[Column] | str, *, seed: int = 0, scale: float = 1.0, clip: Region | None = None) -> DataFrame:
    """Offspring of parents (index, positions): ``count`` each, placed by ``step``: 'normal' (deviation ``scale``) or 'ball' (uniform
    in a ball of radius ``scale``). Adds cluster_label; ``clip`` drops what leaves the region."""
    coords = coordinates(parents.columns)
    rows = parents.withColumn("_n", count).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    keys = [F.col("index"), F.col("_k")]
    if step == "normal":
        moves = [normal(seed, f"step/{c}", *keys) * scale for c in coords]
    else:
        g = [normal(seed, f"ball/{c}", *keys) for c in coords]
        norm = F.sqrt(sum((x * x for x in g), F.lit(0.0)))
        reach = F.pow(uniform(seed, "reach", *keys), F.lit(1 / len(coords))) * scale
        moves = [x / norm * reach for x in g]
    out = rows.select(F.col("index").alias("cluster_label"), "_k", *((F.col(c) + m).alias(c) for c, m in zip(coords, moves)))
    if clip is not None:
        out = out.where(clip.contains([F.col(c) for c in coords]))
    return out.withColumn("index", F.xxhash64("cluster_label", "_k")).drop("_k")


def simulate_neyman_scott(spark: SparkSession, parent_intensity: float, count: Column, step: str, scale: float, region=(0, 1), expansion_distance: float = 0, clip: bool = True, seed: int = 0) -> DataFrame:
    """Poisson parents in the region grown by a distance, with given offspring."""
    r = _region(region)
    return simulate_cluster(simulate_poisson(spark, parent_intensity, _grown(r, expansion_distance), seed), count, step, seed=seed, scale=scale, clip=r if clip else None)


def simulate_matern(spark: SparkSession, parent_intensity: float = 1, region=(0, 1), cluster_mu: float = 1, radius: float = 1.0, clip: bool = True, seed: int = 0) -> DataFrame:
    """Poisson numbers of offspring, uniform in balls."""
    return simulate_neyman_scott(spark, parent_intensity, poisson(cluster_mu, uniform(seed, "n", F.col("index"))), "ball", radius, region, radius, clip, seed)


def simulate_thomas(spark: SparkSession, parent_intensity: float = 1, region=(0, 1), cluster_mu: float = 1, cluster_std: float = 1.0, expansion_factor: float = 6, clip: bool = True, seed: int = 0) -> DataFrame:
    """Poisson numbers of offspring, normal around their parent."""
    return simulate_neyman_scott(spark, parent_intensity, poisson(cluster_mu, uniform(seed, "n", F.col("index"))), "normal", cluster_std, region, expansion_factor * cluster_std, clip, seed)


def simulate_dstorm(spark: SparkSession, parent_intensity: float = 1, region=(0, 1), cluster_mu: float = 1, min_points: int = 0, cluster_std: float = 1.0, expansion_factor: float = 6, clip: bool = True, seed: int = 0) -> DataFrame:
    """Geometric numbers of offspring from ``min_points`` on with mean ``cluster_mu``, normal around their parent."""
    mean = cluster_mu - min_points
    if mean < 0:
        raise ValueError("cluster_mu is at least min_points")
    u = uniform(seed, "n", F.col("index"))
    count = F.lit(min_points) if mean == 0 else (F.floor(F.ln(u) / math.log(mean / (1 + mean))) + min_points).cast("int")
    return simulate_neyman_scott(spark, parent_intensity, count, "normal", cluster_std, region, expansion_factor * cluster_std, clip, seed)


def simulate_tracks(spark: SparkSession, n_walks: int = 1, n_steps: int = 10, ranges=((0, 10000), (0, 10000)), diffusion_constant: float = 1, time_step: float = 10, seed: int = 0) -> DataFrame:
    """Random walks: from a uniform start, every axis moves by sqrt(2 d D dt) to one side or the other each frame."""
    d = len(ranges)
    step = math.sqrt(2 * d * diffusion_constant * time_step)
    rows = spark.range(n_walks).withColumnRenamed("id", "cluster_label").withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_steps - 1).cast("long"))))
    w = Window.partitionBy("cluster_label").orderBy("frame")
    out = rows.select("cluster_label", "frame", *(F.when(uniform(seed, f"side/{k}", F.col("cluster_label"), F.col("frame")) < 0.5, -step).otherwise(step).alias(f"_s{k}") for k in range(d)))
    start = [F.lit(float(lo)) + uniform(seed, f"start/{k}", F.col("cluster_label")) * float(hi - lo) for k, (lo, hi) in enumerate(ranges)]
    return out.select((F.col("cluster_label") * n_steps + F.col("frame")).alias("index"), "cluster_label", "frame", *((s + F.sum(f"_s{k}").over(w)).alias(COORDINATES[k]) for k, s in enumerate(start)))


def resample(df: DataFrame, n_samples: int = 10, seed: int = 0, id_col: str = "index") -> DataFrame:
    """``n_samples`` copies of every row, moved by its uncertainties; ``original_index`` keeps the row's id."""
    from ..catalog import per_dimension

    coords = coordinates(df.columns)
    rows = df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(n_samples))))
    new = {c: F.col(c) + normal(seed, c, F.col(id_col), F.col("_k")) * F.col(u) for c, u in zip(coords, per_dimension(df.columns, "uncertainty")) if u}
    return rows.withColumns(new).withColumn("original_index", F.col(id_col)).withColumn(id_col, F.xxhash64(id_col, "_k")).drop("_k")


def simulate_frame_numbers(spark: SparkSession, n: int, lam: float, seed: int = 0) -> DataFrame:
    """(index, frame) of n rows, frames holding Poisson numbers of rows of mean ``lam``."""
    sizes = np.random.default_rng(seed).poisson(lam, size=int(2 * n / lam + 20 + 10 * math.sqrt(n / lam)))
    ends = np.cumsum(sizes)
    frames = spark.createDataFrame([(int(k), int(e - s), int(e)) for k, (s, e) in enumerate(zip(sizes, ends)) if s and e - s < n], "frame long, _a long, _b long")
    return frames.select("frame", F.explode(F.sequence("_a", F.col("_b") - 1)).alias("index")).where(F.col("index") < n)


def simulate_centers(spark: SparkSession, centers: int | Sequence[Sequence[float]] = 3, region=(0, 1), expansion_distance: float = 0, offspring: Sequence[Sequence[Sequence[float]]] | None = None, clip: bool = True, seed: int = 0) -> DataFrame:
    """Given or uniform cluster centres (in the region grown by a distance), each replaced by its own list of points around it
    if lists are given, one per centre or more. ``clip`` drops what is outside the region. Adds cluster_label."""
    r = _region(region)
    names = COORDINATES[: r.dimension]
    if isinstance(centers, int):
        parents = simulate_uniform(spark, centers, _grown(r, expansion_distance), seed)
        n = centers
    else:
        if any(len(c) != r.dimension for c in centers):
            raise ValueError("centres and region differ in dimension")
        n = len(centers)
        parents = spark.createDataFrame([(k, *map(float, c)) for k, c in enumerate(centers)], "index long" + "".join(f", {c} double" for c in names))
    out = parents.withColumn("cluster_label", F.col("index"))
    if offspring is not None:
        if len(offspring) < n:
            raise ValueError("every centre needs a list of points")
        rows = [(i, k, *map(float, p)) for i, own in enumerate(offspring[:n]) for k, p in enumerate(own)]
        moves = spark.createDataFrame(rows, "cluster_label long, _k long" + "".join(f", _{c} double" for c in names))
        out = out.drop("index").join(moves, "cluster_label").withColumns({c: F.col(c) + F.col(f"_{c}") for c in names})
        out = out.withColumn("index", F.xxhash64("cluster_label", "_k")).drop("_k", *(f"_{c}" for c in names))
    return out.where(r.contains([F.col(c) for c in names])) if clip else out


def randomize(df: DataFrame, seed: int = 0, hull: str | Region = "bb") -> DataFrame:
    """As many uniform points as the frame has, in its bounding box ('bb'), convex hull ('ch'), smallest rectangle ('obb') or a region.

    The two hulls are of planar points; their corners come to the driver, few beside the rows, but as many as rows if all lie on a convex curve."""
    coords = coordinates(df.columns)
    if isinstance(hull, Region):
        return simulate_uniform(df.sparkSession, df.count(), hull, seed)
    if hull in ("ch", "obb"):
        from .hulls import convex_hull, hull_vertices, rectangle_corners

        if len(coords) != 2:
            raise ValueError("convex hulls and smallest rectangles are of planar points")
        v = convex_hull(hull_vertices(df.withColumn("_all", F.lit(0)), "_all").select("x", "y").toPandas().to_numpy(float))
        if len(v) < 3:
            raise ValueError("the points have no hull")
        return simulate_uniform(df.sparkSession, df.count(), Polygon(tuple(map(tuple, (v if hull == "ch" else rectangle_corners(v)).tolist()))), seed)
    if hull != "bb":
        raise ValueError("hull is bb, ch, obb or a region")
    r = df.agg(F.count("*"), *(f(c) for c in coords for f in (F.min, F.max))).first()
    return simulate_uniform(df.sparkSession, r[0], [(r[1 + 2 * k], r[2 + 2 * k] + 1e-12) for k in range(len(coords))], seed)


def add_drift(df: DataFrame, *, diffusion_constant: Sequence[float] | None = None, velocity: Sequence[float] | None = None, seed: int = 0) -> DataFrame:
    """Coordinates moved by a steady velocity and by a random walk over the frames (one step per frame that can occur)."""
    coords = coordinates(df.columns)
    top = df.agg(F.max("frame")).first()[0] or 0
    frames = df.sparkSession.range(top + 1).withColumnRenamed("id", "frame")
    w = Window.orderBy("frame")  # over distinct frames only
    shifts = []
    for k in range(len(coords)):
        s = F.col("frame") * float(velocity[k]) if velocity is not None else F.lit(0.0)
        if diffusion_constant is not None:
            s = s + F.sum(normal(seed, f"drift/{k}", F.col("frame")) * math.sqrt(2 * diffusion_constant[k])).over(w)
        shifts.append(s.alias(f"_d{k}"))
    out = df.join(frames.select("frame", *shifts), "frame")
    return out.withColumns({c: F.col(c) + F.col(f"_d{k}") for k, c in enumerate(coords)}).drop(*(f"_d{k}" for k in range(len(coords))))
