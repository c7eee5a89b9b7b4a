"""Core points and their links without the list of all pairs within reach.

Points go to cells so small that all points of one are within reach of each other. A cell of ``min_samples`` points or more holds
core points only; the points of other cells, fewer than ``min_samples`` of each, meet the points of the cells around. So both
kinds of pairs grow with the points, however dense they lie. Cells, not points, are linked: two cells of many points by one point of each part of
them, parts that are too far apart go, the others are cut finer until few points are left to compare.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, written
from .spatial import distance

#: Point pairs of cells that are compared without cutting the cells finer.
PAIRS = 5_000_000
#: Cells from the origin up to which the cell of a coordinate is sure.
FAR = 2.0**40


def cell_edge(eps: float, axes: int) -> float:
    """Edge of a cell whose points are all within ``eps``, rounding included."""
    return eps / math.sqrt(axes) * 0.999


def _around(axes: int) -> list[tuple[int, ...]]:
    """Steps to the cells that can hold points within reach; the cell's own is left out."""
    return [s for s in itertools.product((-2, -1, 0, 1, 2), repeat=axes) if any(s)]


def _stepped(df: DataFrame, steps: list[tuple[int, ...]], cell: list[str]) -> DataFrame:
    """``df`` once for each of the steps, ``cell`` moved by it."""
    out = df.withColumn("_s", F.explode(F.array(*(F.array(*map(F.lit, s)) for s in steps))))
    return out.withColumns({c: F.col(c) + F.col("_s")[k] for k, c in enumerate(cell)}).drop("_s")


def _marked(df: DataFrame, mark: str, *kept: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{mark}" for c in df.columns if c not in kept})


def _length(parts: list[Column]) -> Column:
    total = parts[0] * parts[0]
    for x in parts[1:]:
        total = total + x * x
    return F.sqrt(total)


def _cell_links(dense: DataFrame, links: DataFrame, eps: float, edge: float, axes: list[str], cell: list[str]) -> DataFrame:
    """``links`` and those among cells of many points (a, b), as far as these join what was apart."""
    finer = [f"p{k}" for k in range(len(axes))]
    own = dense.groupBy("node", *cell).agg(F.lit(1).alias("_n")).drop("_n")
    half = [s for s in _around(len(axes)) if s > tuple([0] * len(axes))]
    open_ = _stepped(own, half, cell).join(_marked(own, "2", *cell), cell).select(F.col("node").alias("a"), F.col("node2").alias("b"))
    own = own.withColumnsRenamed(dict(zip(cell, finer)))
    pairs = written(open_.join(_marked(own, "1").withColumnRenamed("node1", "a"), "a").join(_marked(own, "2").withColumnRenamed("node2", "b"), "b"))
    level = 0
    while True:
        level += 1
        if level > 1:
            wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
            now = dense.join(wanted, "node", "left_semi")
        else:
            now = dense
        now = now.withColumns({f"s{k}": F.floor(F.col(x) / F.lit(edge / 2**level)) for k, x in enumerate(axes)})
        held = now.groupBy("node", *(f"s{k}" for k in range(len(axes)))).agg(F.count("*").alias("n"), F.min(F.struct("id", *axes)).alias("one"), *(f(x).alias(f"{m}{k}") for k, x in enumerate(axes) for f, m in ((F.min, "lo"), (F.max, "hi"))))
        held = written(held.withColumns({p: F.shiftright(f"s{k}", 1) for k, p in enumerate(finer)}))
        tried = pairs.join(_marked(held, "1").withColumnRenamed("node1", "a"), ["a", *(f"{p}1" for p in finer)]).join(_marked(held, "2").withColumnRenamed("node2", "b"), ["b", *(f"{p}2" for p in finer)])
        gap = _length([F.greatest(F.lit(0.0), F.col(f"lo{k}1") - F.col(f"hi{k}2"), F.col(f"lo{k}2") - F.col(f"hi{k}1")) for k in range(len(axes))])
        near = distance([F.col(f"one1.{x}") for x in axes], [F.col(f"one2.{x}") for x in axes])
        tried = written(tried.where(gap <= eps).select("a", "b", *(f"s{k}{m}" for k in range(len(axes)) for m in "12"), "n1", "n2", (near <= eps).alias("near")))
        links = written(links.unionByName(tried.where("near").select("a", "b")).distinct())
        found = components(links)
        of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
        apart = tried.where("not near").join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).drop("_a", "_b", "near")
        apart = written(apart)
        load = apart.agg(F.sum(F.col("n1").cast("double") * F.col("n2"))).first()[0]
        if not load:
            return links
        if load <= PAIRS or level == 20:
            side = lambda c, m: now.select(F.col("node").alias(c), *(F.col(f"s{k}").alias(f"s{k}{m}") for k in range(len(axes))), *(F.col(x).alias(f"{x}_{m}") for x in axes))
            met = apart.join(side("a", "1"), ["a", *(f"s{k}1" for k in range(len(axes)))]).join(side("b", "2"), ["b", *(f"s{k}2" for k in range(len(axes)))])
            met = met.where(distance([F.col(f"{x}_1") for x in axes], [F.col(f"{x}_2") for x in axes]) <= eps)
            return links.unionByName(met.select("a", "b").distinct())
        pairs = apart.select("a", "b", *(F.col(f"s{k}{m}").alias(f"{finer[k]}{m}") for k in range(len(axes)) for m in "12"))


def density_members(rows: DataFrame, eps: float, min_samples: int, axes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, component) of the core points, the component being the smallest core id, and (id, component) of every component of a core
    point within ``eps`` of another point. ``rows`` are (id, ``axes``), without nulls and within ``FAR`` cells."""
    edge, cell = cell_edge(eps, len(axes)), [f"g{k}" for k in range(len(axes))]
    steps = _around(len(axes))
    rows = rows.withColumns({g: F.floor(F.col(x) / F.lit(edge)) for g, x in zip(cell, axes)})
    rows = written(rows)
    points = written(rows.join(rows.groupBy(*cell).agg(F.count("*").alias("n")), cell))
    few = points.where(F.col("n") < min_samples)
    close = distance([F.col(x) for x in axes], [F.col(f"{x}2") for x in axes]) <= eps
    met = _stepped(few.select("id", *axes, *cell), steps, cell).join(_marked(points.select("id", *axes, *cell), "2", *cell), cell).where(close)
    few = few.join(met.groupBy("id").agg(F.count("*").alias("_met")), "id", "left")
    few = written(few.withColumn("core", F.col("n") + F.coalesce("_met", F.lit(0)) >= min_samples).select("id", *axes, *cell, "core"))
    dense = points.where(F.col("n") >= min_samples).select("id", *axes, *cell)
    core = dense.withColumn("dense", F.lit(True)).unionByName(few.where("core").drop("core").withColumn("dense", F.lit(False)))
    core = written(core.join(core.groupBy(*cell).agg(F.min("id").alias("node")), cell))
    single = _stepped(core.where("not dense").select("node", *axes, *cell), steps, cell)
    links = single.join(_marked(core.select("node", *axes, *cell), "2", *cell), cell).where(close).select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()
    found = components(_cell_links(core.where("dense").select("id", "node", *axes, *cell), links, eps, edge, axes, cell))
    core = core.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = _stepped(few.where("not core").drop("core"), [tuple([0] * len(axes)), *steps], cell)
    border = rest.join(_marked(core.select("component", *axes, *cell), "2", *cell), cell).where(close).select("id", F.col("component2").alias("component"))
    return core.select("id", "component"), border
