"""Clusters: by density (flat and hierarchical), with parameter sweeps and the accumulation check."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import check_columns
from . import density, hierarchy
from .components import components, written
from .filters import numbered_rows
from .spatial import radius_pairs


def dbscan(df: DataFrame, *, eps: float = 20, min_samples: int = 5, id_col: str = "index", coords: Sequence[str] | None = None) -> DataFrame:
    """Add ``cluster_label``: 1, 2, ... in order of the smallest core member, -1 for noise.

    A core point has ``min_samples`` points within ``eps``, itself included. Core points within
    eps share a cluster (connected components); another point joins the lowest cluster of a core point within eps.
    """
    coords = check_columns(df.columns, coords)
    if eps <= 0 or not math.isfinite(eps):
        raise ValueError("eps is a positive number")
    axes = [f"x{k}" for k in range(len(coords))]
    rows = df.select(F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(x) for c, x in zip(coords, axes)))
    reach = density.cell_edge(eps, len(axes)) * density.FAR
    finite = functools.reduce(lambda a, b: a & b, [F.coalesce(F.abs(x) < float("inf"), F.lit(False)) for x in axes])
    far = functools.reduce(lambda a, b: a | b, [F.abs(x) >= reach for x in axes])
    if rows.where(finite & far).limit(1).count():  # cells are no longer sure
        core, border = _by_pairs(rows.where(finite), eps, min_samples, axes)
    else:
        core, border = density.density_members(rows.where(finite).dropna(subset=["id"]), eps, min_samples, axes)
    if min_samples <= 1:  # points without a place are near themselves
        core = core.unionByName(rows.where(~finite).select("id", F.col("id").alias("component")))
    core = written(core)
    number = numbered_rows(core.select("component").distinct(), [F.col("component")], "label").withColumn("label", F.col("label") + 1)
    number = written(number)
    border = border.distinct().join(number, "component").groupBy("id").agg(F.min("label").alias("label"))
    labels = core.join(number, "component").select("id", "label").unionByName(border.select("id", "label"))
    return df.drop("cluster_label").join(labels.withColumnRenamed("id", id_col), id_col, "left").withColumn("cluster_label", F.coalesce("label", F.lit(-1)).cast("long")).drop("label")


def _by_pairs(rows: DataFrame, eps: float, min_samples: int, axes: list[str]) -> tuple[DataFrame, DataFrame]:
    """What ``density_members`` gives, for coordinates of any size, from all pairs within ``eps``."""
    pairs = written(radius_pairs(rows, radius=eps, id_col="id", coords=axes).select("id1", "id2"))
    near = pairs.groupBy("id1").agg(F.count("*").alias("n"))
    core = written(rows.select(F.col("id").alias("id1")).join(near, "id1", "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select(F.col("id1").alias("c")))
    edges = pairs.where("id1 < id2").join(core, F.col("id1") == F.col("c")).drop("c").join(core, F.col("id2") == F.col("c")).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    member = core.join(components(edges), F.col("c") == F.col("node"), "left").select(F.col("c").alias("id"), F.coalesce("component", "c").alias("component"))
    border = pairs.join(core, F.col("id1") == F.col("c"), "left_anti").join(member, F.col("id2") == F.col("id")).select(F.col("id1").alias("id"), "component")
    return member, border


def hdbscan(df: DataFrame, *, min_cluster_size: int = 5, allow_single_cluster: bool = False, tile: str | None = None, id_col: str = "index", coords: Sequence[str] | None = None) -> DataFrame:
    """Add ``cluster_label`` by hierarchical density clusters, exactly, within each group of ``tile``: 1, 2, ... by smallest member, -1 for noise.

    A point falls out of a cluster where its component gets smaller than ``min_cluster_size``; where two components of that size or larger come
    apart, clusters begin; of nested clusters those of the larger excess of mass are kept. Links of one length count at once.
    Groups of up to ``hierarchy.SMALL`` rows are clustered whole, side by side; larger ones one after another, each
    spread over all tasks. Rows with a null coordinate are noise. Ids are unique integers.
    """
    if min_cluster_size < 2:
        raise ValueError("a cluster has at least two points")
    axes = list(check_columns(df.columns, coords))
    out = df.drop("cluster_label").withColumn("_tile", F.col(tile) if tile else F.lit(0))
    rows = written(out.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(axes)), "_tile").dropna(subset=["id", *(f"x{k}" for k in range(len(axes)))]))
    names = [f"x{k}" for k in range(len(axes))]
    sizes = rows.groupBy("_tile").count()
    large = [r["_tile"] for r in sizes.where(F.col("count") > hierarchy.SMALL).select("_tile").toLocalIterator()]  # at most rows / SMALL
    rest = rows.where(~F.coalesce(F.col("_tile").isin(large), F.lit(False))) if large else rows

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"id": pdf["id"], "cluster_label": hierarchy.labels_of(pdf[names].to_numpy(float), min_cluster_size, allow_single_cluster)})

    labels = rest.groupBy("_tile").applyInPandas(run, "id long, cluster_label long")
    for t in large:
        own = rows.where(F.col("_tile").eqNullSafe(F.lit(t))).drop("_tile")
        labels = labels.unionByName(hierarchy.hierarchical_labels(own, min_cluster_size, allow_single_cluster, names))
    labels = labels.withColumnRenamed("id", "_id")
    return out.join(labels, F.col(id_col).cast("long") == F.col("_id"), "left").withColumn("cluster_label", F.coalesce("cluster_label", F.lit(-1).cast("long"))).drop("_tile", "_id")


def serial_clustering(df: DataFrame, algorithm: Callable[..., DataFrame], parameters: dict[str, Sequence]) -> DataFrame:
    """Clusters for every combination of parameter values, which become columns; one plan."""
    out = None
    for values in itertools.product(*parameters.values()):
        own = algorithm(df, **dict(zip(parameters, values)))
        own = own.withColumns({f"parameter_{k}": F.lit(v) for k, v in zip(parameters, values)})
        out = own if out is None else out.unionByName(own)
    return out


def accumulation_check(df: DataFrame, *, region_measure: float, algorithm: Callable[[DataFrame], DataFrame], sizes: Sequence[int] | int = 10, n_extrapolate: int = 5, id_col: str = "index", seed: int = 0) -> DataFrame:
    """(n, density, eta, rho, rho_0, rho_rel): clusters of random subsets of growing size; eta is the covered share of the
    region, rho the density within clusters, rho_0 its value extrapolated to density 0 from the first subsets (1 if that is not positive).
    A number of ``sizes`` stands for so many even steps up to all rows."""
    from .filters import random_subset
    from .properties import collection_properties

    if isinstance(sizes, int):
        sizes = np.linspace(0, df.count(), sizes + 1, dtype=int)[1:].tolist()
    parts = None
    for n in sizes:
        rows = algorithm(random_subset(df, n, replace=False, seed=seed, id_col=id_col))
        boxes = collection_properties(rows.where("cluster_label > 0"), "cluster_label")
        own = boxes.agg(F.sum("region_measure_bb").alias("covered"), F.avg("localization_density_bb").alias("rho")).select(F.lit(n).alias("n"), F.lit(n / region_measure).alias("density"), (F.coalesce("covered", F.lit(0.0)) / region_measure).alias("eta"), "rho")
        parts = own if parts is None else parts.unionByName(own)
    parts = written(parts)
    first = parts.where("rho is not null").orderBy("n").limit(n_extrapolate)
    zero = first.agg(F.regr_intercept("rho", "density").alias("rho_0")).select(F.when(F.col("rho_0") <= 0, 1.0).otherwise(F.col("rho_0")).alias("rho_0"))
    return parts.crossJoin(F.broadcast(zero)).withColumn("rho_rel", F.col("rho") / F.col("rho_0"))  # one row is broadcast
