"""The named queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions, regions
from ..functions.binning import Bins
from ..operators import binned, clustering, filters, frames, hulls, properties, simulate, spatial, spatial_stats, transforms
from ..sources import files
from .views import loc_emb, loc_emb_2d, loc_ev, loc_li, loc_ord, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RADII = (0.01, 0.02, 0.03, 0.05)
POLYGON = ((-0.2, -0.15), (0.1, -0.2), (0.25, 0.05), (0.0, 0.2), (-0.05, 0.0), (-0.22, 0.12))
D12 = "sqrt((a.position_x - b.position_x) * (a.position_x - b.position_x) + (a.position_y - b.position_y) * (a.position_y - b.position_y))"
PAIRS = f"pairs AS (SELECT a.index AS i, b.index AS j, {D12} AS d FROM loc_emb a, loc_emb b WHERE a.index <> b.index)"


def query(name: str, oracle: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return keep


def r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Columns rounded: engines add up in different orders."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# selections

@query("select_by_condition", sql("SELECT position_x, position_y, frame FROM loc_li WHERE 20000 < position_x AND position_x < 40000 AND position_y > 30"))
def _(s, d):
    return filters.select_by_condition(loc_li(s, d), "20000 < position_x < 40000 AND position_y > 30").select("position_x", "position_y", "frame")


@query("select_by_selectors", sql("SELECT position_x, frame FROM loc_li WHERE 1000 < position_x AND position_x < 9000 AND 100 < frame AND frame < 900"))
def _(s, d):
    chosen = [filters.Selector("position_x", True, 1000, 9000), filters.Selector("frame", True, 100, 900), filters.Selector("position_y", False, 0, 1)]
    return filters.select_by_condition(loc_li(s, d), chosen).select("position_x", "frame")


@query("select_by_region_rect", sql("SELECT index FROM loc_emb WHERE position_x >= -0.1 AND position_x < 0.1 AND position_y >= -0.05 AND position_y < 0.15"))
def _(s, d):
    return filters.select_by_region(loc_emb_2d(s, d), regions.AxisOrientedRectangle((-0.1, -0.05), 0.2, 0.2)).select("index")


@query("select_by_region_ellipse", sql("SELECT index FROM loc_emb WHERE power((position_x * cos(radians(30)) + position_y * sin(radians(30))) / 0.15, 2) + power((position_y * cos(radians(30)) - position_x * sin(radians(30))) / 0.08, 2) < 1"))
def _(s, d):
    return filters.select_by_region(loc_emb_2d(s, d), regions.Ellipse((0, 0), 0.3, 0.16, 30)).select("index")


def _edges() -> str:
    return ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(POLYGON, POLYGON[1:] + POLYGON[:1]))


@query("select_by_region_polygon", sql(f"SELECT index FROM loc_emb, (VALUES {_edges()}) e(x0, y0, x1, y1) GROUP BY index HAVING count(*) FILTER (((y0 > position_y) <> (y1 > position_y)) AND position_x < (x1 - x0) * (position_y - y0) / (y1 - y0) + x0) % 2 = 1"))
def _(s, d):
    return filters.select_by_region(loc_emb_2d(s, d), regions.Polygon(POLYGON)).select("index")


@query("select_by_image_mask", sql("SELECT index FROM loc_emb WHERE floor((position_x + 0.3) / 0.06) BETWEEN 0 AND 9 AND floor((position_y + 0.3) / 0.06) BETWEEN 0 AND 9 AND (floor((position_x + 0.3) / 0.06) + floor((position_y + 0.3) / 0.06)) % 3 <> 0"))
def _(s, d):
    bins = Bins.of(n_bins=10, bin_range=[(-0.3, 0.3), (-0.3, 0.3)])
    mask = binned.image_from_bins(s, bins).withColumn("value", ((F.col("b0") + F.col("b1")) % 3).cast("double"))
    return filters.select_by_image_mask(loc_emb_2d(s, d), mask, bins).select("index")


@query("exclude_sparse_points", sql("SELECT i AS index FROM pairs WHERE d <= 0.02 GROUP BY i HAVING count(*) >= 5", PAIRS))
def _(s, d):
    return filters.exclude_sparse_points(loc_emb_2d(s, d), radius=0.02, min_samples=5).select("index")


@query("localizations_in_regions", sql("SELECT index, 0 AS region_id FROM loc_emb WHERE position_x >= -0.1 AND position_x < 0.05 AND position_y >= -0.1 AND position_y < 0.05 UNION ALL SELECT index, 1 FROM loc_emb WHERE position_x >= 0 AND position_x < 0.2 AND position_y >= 0 AND position_y < 0.2"))
def _(s, d):
    two = {0: regions.AxisOrientedRectangle((-0.1, -0.1), 0.15000000000000002, 0.15000000000000002), 1: regions.AxisOrientedRectangle((0, 0), 0.2, 0.2)}
    return filters.localizations_in_regions(loc_emb_2d(s, d), two).select("index", "region_id")


@query("random_subset")
def _(s, d):
    return filters.random_subset(loc_emb_2d(s, d), 100, replace=False, seed=7)


@query("concat", sql("SELECT position_x, frame, channel FROM loc_ev UNION ALL BY NAME SELECT position_x, frame FROM loc_ord"))
def _(s, d):
    return filters.concat([loc_ev(s, d), loc_ord(s, d)]).select("position_x", "frame", "channel")


@query("projection", sql("SELECT index, position_x, cluster_label FROM loc_emb"))
def _(s, d):
    return filters.projection(loc_emb(s, d), "position_x")


@query("chunks_successive", sql("SELECT index, CAST((row_number() OVER (ORDER BY index) - 1) // 700 AS INTEGER) AS chunk FROM loc_ev"))
def _(s, d):
    return filters.chunks(loc_ev(s, d), order_by="index", chunk_size=700).select("index", "chunk")


@query("chunks_alternating", sql("SELECT index, CAST((row_number() OVER (ORDER BY index) - 1) % 7 AS INTEGER) AS chunk FROM loc_ev"))
def _(s, d):
    return filters.chunks(loc_ev(s, d), order_by="index", n_chunks=7, order="alternating").select("index", "chunk")


@query("rasterize", sql("SELECT index, CAST(floor((position_x + 0.4) / 0.2) AS INTEGER) AS tile_x, CAST(floor((position_y + 0.4) / 0.4) AS INTEGER) AS tile_y FROM loc_emb WHERE position_x >= -0.4 AND position_x < 0.4 AND position_y >= -0.4 AND position_y < 0.4"))
def _(s, d):
    return filters.rasterize(loc_emb_2d(s, d), (4, 2), bounds=[(-0.4, 0.4), (-0.4, 0.4)]).select("index", "tile_x", "tile_y")


# properties

_STAT = "count({c}) AS {c}_count, min({c}) AS {c}_min, max({c}) AS {c}_max, round(avg({c}), 6) AS {c}_mean, median({c}) AS {c}_median, round(stddev_samp({c}), 6) AS {c}_std, round(stddev_samp({c}) / sqrt(count({c})), 6) AS {c}_sem"


@query("statistics", sql(f"SELECT {_STAT.format(c='position_x')}, {_STAT.format(c='position_y')} FROM loc_li"))
def _(s, d):
    out = properties.statistics(loc_li(s, d), ["position_x", "position_y"])
    return r(out, *(f"{c}_{k}" for c in ("position_x", "position_y") for k in ("mean", "std", "sem")))


@query("ranges", sql("SELECT min(position_x) AS position_x_min, max(position_x) AS position_x_max, min(position_y) AS position_y_min, max(position_y) AS position_y_max FROM loc_li"))
def _(s, d):
    return properties.ranges(loc_li(s, d))


@query("ranges_link", sql("SELECT lo AS position_x_min, hi AS position_x_max, lo AS position_y_min, hi AS position_y_max FROM (SELECT least(min(position_x), min(position_y)) AS lo, greatest(max(position_x), max(position_y)) AS hi FROM loc_li)"))
def _(s, d):
    return properties.ranges(loc_li(s, d), special="link")


@query("ranges_zero", sql("SELECT CAST(0 AS DOUBLE) AS position_x_min, max(position_x) AS position_x_max, CAST(0 AS DOUBLE) AS position_y_min, max(position_y) AS position_y_max FROM loc_li"))
def _(s, d):
    return properties.ranges(loc_li(s, d), special="zero")


@query("range_from_collection", sql("SELECT min(position_x) AS position_x_min, max(position_x) AS position_x_max FROM (SELECT position_x FROM loc_ev UNION ALL SELECT position_x FROM loc_ord)"))
def _(s, d):
    return properties.range_from_collection([loc_ev(s, d), loc_ord(s, d)], ["position_x"])


_W = "max(position_{c}) - min(position_{c})"


@query("collection_properties", sql(f"SELECT cluster_label, count(*) AS localization_count, round(avg(position_x), 8) AS position_x, round(stddev_samp(position_x) / sqrt(count(*)), 8) AS uncertainty_x, round(avg(position_y), 8) AS position_y, round(stddev_samp(position_y) / sqrt(count(*)), 8) AS uncertainty_y, round(({_W.format(c='x')}) * ({_W.format(c='y')}), 8) AS region_measure_bb, round(2 * (({_W.format(c='x')}) + ({_W.format(c='y')})), 8) AS subregion_measure_bb FROM loc_emb GROUP BY cluster_label"))
def _(s, d):
    out = properties.collection_properties(loc_emb_2d(s, d)).drop("localization_density_bb")
    return r(out, *(c for c, t in out.dtypes if t == "double"), digits=8)


@query("weighted_mean_variance", sql("SELECT round(swx / sw, 6) AS weighted_mean, round(n / ((n - 1) * sw * sw) * (sw2x2 - 2 * (swx / sw) * sw2x + (swx / sw) * (swx / sw) * sw2), 4) AS weighted_mean_variance FROM (SELECT count(*) AS n, sum(position_y) AS sw, sum(position_y * position_x) AS swx, sum(position_y * position_y) AS sw2, sum(position_y * position_y * position_x) AS sw2x, sum(position_y * position_y * position_x * position_x) AS sw2x2 FROM loc_li)"))
def _(s, d):
    mean, var = properties.weighted_moments(F.col("position_x"), F.col("position_y"))
    return loc_li(s, d).agg(F.round(mean, 6).alias("weighted_mean"), F.round(var, 4).alias("weighted_mean_variance"))


@query("bounding_box", sql(f"SELECT cluster_label, min(position_x) AS position_x_min, max(position_x) AS position_x_max, min(position_y) AS position_y_min, max(position_y) AS position_y_max, round(({_W.format(c='x')}) * ({_W.format(c='y')}), 8) AS region_measure_bb, round(count(*) / (({_W.format(c='x')}) * ({_W.format(c='y')})), 4) AS localization_density_bb, round(2 * (({_W.format(c='x')}) + ({_W.format(c='y')})), 8) AS subregion_measure_bb FROM loc_emb GROUP BY cluster_label"))
def _(s, d):
    return r(r(properties.bounding_box(loc_emb_2d(s, d), ["cluster_label"]), "region_measure_bb", "subregion_measure_bb", digits=8), "localization_density_bb", digits=4)


@query("inertia_moments", sql("SELECT cluster_label, round((a + c) / 2 + q, 8) AS eigenvalue_1, round((a + c) / 2 - q, 8) AS eigenvalue_2, round(((a + c) / 2 + q) / (a + c), 6) AS explained_1, round(degrees(atan2(2 * b, a - c) / 2), 4) AS orientation, round(sqrt(greatest(0, 1 - ((a + c) / 2 - q) / ((a + c) / 2 + q))), 6) AS eccentricity FROM (SELECT *, sqrt((a - c) * (a - c) / 4 + b * b) AS q FROM (SELECT cluster_label, var_samp(position_x) AS a, covar_samp(position_x, position_y) AS b, var_samp(position_y) AS c FROM loc_emb GROUP BY cluster_label))"))
def _(s, d):
    out = properties.inertia_moments(loc_emb_2d(s, d), ["cluster_label"])
    return r(r(r(out, "eigenvalue_1", "eigenvalue_2", digits=8), "explained_1", "eccentricity"), "orientation", digits=4)


@query("distance_to_point", sql("SELECT index, sqrt((position_x - 0.1) * (position_x - 0.1) + (position_y + 0.05) * (position_y + 0.05)) AS distance FROM loc_emb"))
def _(s, d):
    return properties.distance_to_point(loc_emb_2d(s, d), (0.1, -0.05)).select("index", "distance")


@query("distance_to_region", sql("SELECT index, round(CASE WHEN position_x > -0.1 AND position_x < 0.1 AND position_y > -0.1 AND position_y < 0.1 THEN 0 ELSE sqrt(power(greatest(abs(position_x) - 0.1, 0), 2) + power(greatest(abs(position_y) - 0.1, 0), 2)) END, 8) AS distance FROM loc_emb"))
def _(s, d):
    square = regions.Polygon(((-0.1, -0.1), (-0.1, 0.1), (0.1, 0.1), (0.1, -0.1)))
    return r(properties.distance_to_region(loc_emb_2d(s, d), square).select("index", "distance"), "distance", digits=8)


@query("property_correlations", sql("SELECT a, b, round(c, 8) AS correlation FROM (SELECT 'position_x' AS a, 'position_y' AS b, corr(position_x, position_y) AS c FROM loc_li UNION ALL SELECT 'position_y', 'position_x', corr(position_y, position_x) FROM loc_li UNION ALL SELECT 'position_x', 'position_x', corr(position_x, position_x) FROM loc_li UNION ALL SELECT 'position_y', 'position_y', corr(position_y, position_y) FROM loc_li)"))
def _(s, d):
    return r(properties.property_correlations(loc_li(s, d), ["position_x", "position_y"]), "correlation", digits=8)


@query("grouped_property_expectation", sql("SELECT channel, round(avg(position_x), 6) AS position_x_mean, round(stddev_samp(position_x), 6) AS position_x_std, CAST(35000 AS DOUBLE) AS expectation, round(avg(position_x) / 35000, 8) AS position_x_ratio FROM loc_li GROUP BY channel"))
def _(s, d):
    return r(r(properties.grouped_expectation(loc_li(s, d), "position_x", "channel", 35000), "position_x_mean", "position_x_std"), "position_x_ratio", digits=8)


@query("position_variance_expectation", sql("SELECT localization_count, round(avg(v), 8) AS position_x_var_mean, round(stddev_samp(v), 8) AS position_x_var_std, count(*) AS n_groups, round(0.0144 * (1 - 1 / localization_count), 8) AS expectation, round(avg(v) / (0.0144 * (1 - 1 / localization_count)), 6) AS ratio FROM (SELECT cluster_label, count(*) AS localization_count, var_pop(position_x) AS v FROM loc_emb GROUP BY cluster_label) GROUP BY localization_count"))
def _(s, d):
    out = properties.position_variance_expectation(loc_emb_2d(s, d), "position_x", "cluster_label", 0.0144)
    return r(r(out, "position_x_var_mean", "position_x_var_std", "expectation", digits=8), "ratio")


# binning

@query("histogram_1d", sql("SELECT CAST(floor((position_x - 0.5) / 2000) AS INTEGER) AS b0, count(*) AS count FROM loc_li WHERE position_x >= 0.5 AND position_x < 60000.5 GROUP BY 1"))
def _(s, d):
    return binned.histogram(loc_li(s, d), Bins.of(n_bins=30, bin_range=(0.5, 60000.5)), ["position_x"])


@query("histogram_2d", sql("SELECT CAST(floor((position_x - 0.5) / 5000) AS INTEGER) AS b0, CAST(floor((position_y - 0.5) / 10) AS INTEGER) AS b1, count(*) AS count FROM loc_li WHERE position_x >= 0.5 AND position_x < 60000.5 AND position_y >= 0.5 AND position_y < 50.5 GROUP BY 1, 2"))
def _(s, d):
    return binned.histogram(loc_li(s, d), Bins.of(bin_size=[5000, 10], bin_range=[(0.5, 60000.5), (0.5, 50.5)]))


@query("histogram_3d", sql("SELECT CAST(floor((position_x + 0.4) / 0.2) AS INTEGER) AS b0, CAST(floor((position_y + 0.4) / 0.2) AS INTEGER) AS b1, CAST(floor((position_z + 0.4) / 0.2) AS INTEGER) AS b2, count(*) AS count FROM loc_emb WHERE position_x >= -0.4 AND position_x < 0.4 AND position_y >= -0.4 AND position_y < 0.4 AND position_z >= -0.4 AND position_z < 0.4 GROUP BY 1, 2, 3"))
def _(s, d):
    return binned.histogram(loc_emb(s, d), Bins.of(n_bins=4, bin_range=[(-0.4, 0.4)] * 3))


@query("histogram_mean_2d", sql("SELECT CAST(floor((position_x - 0.5) / 5000) AS INTEGER) AS b0, CAST(floor((position_y - 0.5) / 10) AS INTEGER) AS b1, round(avg(local_background), 8) AS mean FROM loc_li WHERE position_x >= 0.5 AND position_x < 60000.5 AND position_y >= 0.5 AND position_y < 50.5 GROUP BY 1, 2"))
def _(s, d):
    return r(binned.histogram(loc_li(s, d), Bins.of(bin_size=[5000, 10], bin_range=[(0.5, 60000.5), (0.5, 50.5)]), value="local_background"), "mean", digits=8)


@query("histogram_edges_dense", sql("SELECT b0, count(position_x) AS count FROM (SELECT * FROM (VALUES (0, 0, 10), (1, 10, 1000), (2, 1000, 3000.5), (3, 3000.5, 90000), (4, 90000, 900000)) v(b0, lo, hi)) LEFT JOIN loc_li ON position_x >= lo AND position_x < hi GROUP BY b0"))
def _(s, d):
    return binned.histogram(loc_li(s, d), Bins.of(bin_edges=[0, 10, 1000, 3000.5, 90000, 900000]), ["position_x"], dense=True)


@query("cluster_by_bin", sql("SELECT b0, b1, count(*) AS cluster_count FROM (SELECT CASE WHEN position_x < 0.5 THEN 0 WHEN position_x >= 40000.5 THEN 5 ELSE CAST(floor((position_x - 0.5) / 10000) AS INTEGER) + 1 END AS b0, CASE WHEN position_y < 0.5 THEN 0 WHEN position_y >= 40.5 THEN 5 ELSE CAST(floor((position_y - 0.5) / 10) AS INTEGER) + 1 END AS b1 FROM loc_li) GROUP BY b0, b1 HAVING count(*) >= 50"))
def _(s, d):
    out = binned.cluster_by_bin(loc_li(s, d), Bins.of(n_bins=4, bin_range=[(0.5, 40000.5), (0.5, 40.5)]), min_samples=50)
    return out.groupBy("b0", "b1").agg(F.count("*").alias("cluster_count"))


# clusters

@query("cluster_dbscan", f"WITH RECURSIVE loc_emb AS (SELECT vec_id AS index, CAST(embedding[1] AS DOUBLE) AS position_x, CAST(embedding[2] AS DOUBLE) AS position_y FROM embeddings), {PAIRS}, near AS (SELECT i, j FROM pairs WHERE d <= 0.02), core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 4), link AS (SELECT i, j FROM near WHERE i IN (FROM core) AND j IN (FROM core)), reach(a, b) AS (SELECT i, i FROM core UNION SELECT a, j FROM reach JOIN link ON b = i), comp AS (SELECT b AS i, min(a) AS c FROM reach GROUP BY b), lab AS (SELECT i, dense_rank() OVER (ORDER BY c) AS l FROM comp), border AS (SELECT n.i, min(l) AS l FROM near n JOIN lab ON lab.i = n.j WHERE n.i NOT IN (FROM core) GROUP BY n.i) SELECT index, CAST(coalesce(lab.l, border.l, -1) AS BIGINT) AS cluster_label FROM loc_emb LEFT JOIN lab ON lab.i = index LEFT JOIN border ON border.i = index")
def _(s, d):
    return clustering.dbscan(loc_emb_2d(s, d), eps=0.02, min_samples=5).select("index", "cluster_label")


@query("cluster_hdbscan")
def _(s, d):
    return clustering.hdbscan(loc_emb_2d(s, d), min_cluster_size=5).select("index", "cluster_label")


@query("serial_clustering")
def _(s, d):
    out = clustering.serial_clustering(loc_emb_2d(s, d), lambda df, **p: clustering.dbscan(df, **p), {"eps": [0.015, 0.02], "min_samples": [4, 5]})
    return out.groupBy("parameter_eps", "parameter_min_samples").agg(F.countDistinct(F.when(F.col("cluster_label") > 0, F.col("cluster_label"))).alias("n_clusters"), F.count_if(F.col("cluster_label") < 0).alias("n_noise"))


@query("accumulation_check")
def _(s, d):
    return clustering.accumulation_check(loc_emb_2d(s, d), region_measure=1.0, algorithm=lambda df: clustering.dbscan(df, eps=0.03, min_samples=4))


# joins and spatial statistics

_NN = "SELECT i AS index, round(d, 9) AS nn_distance, j AS nn_index FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM pairs) WHERE k = {k}"


@query("nearest_neighbor_distances", sql(_NN.format(k=1), PAIRS))
def _(s, d):
    return r(spatial_stats.nearest_neighbor_distances(loc_emb_2d(s, d)), "nn_distance", digits=9)


@query("knn_k3", sql(_NN.format(k=3), PAIRS))
def _(s, d):
    return r(spatial_stats.nearest_neighbor_distances(loc_emb_2d(s, d), k=3), "nn_distance", digits=9)


@query("nn_cross", sql(f"SELECT i AS index, round(d, 9) AS nn_distance, j AS nn_index FROM (SELECT a.index AS i, b.index AS j, {D12} AS d, row_number() OVER (PARTITION BY a.index ORDER BY {D12}, b.index) AS k FROM loc_emb a, loc_emb b WHERE a.cluster_label < 5 AND b.cluster_label >= 5) WHERE k = 1"))
def _(s, d):
    p = loc_emb_2d(s, d)
    return r(spatial_stats.nearest_neighbor_distances(p.where("cluster_label < 5"), p.where("cluster_label >= 5")), "nn_distance", digits=9)


@query("pair_distances", sql(f"SELECT a.index AS id1, b.index AS id2, {D12} AS pair_distance FROM loc_emb a, loc_emb b WHERE a.index < b.index"))
def _(s, d):
    return spatial.pair_distances(loc_emb_2d(s, d))


@query("pair_distances_cross", sql(f"SELECT a.index AS id1, b.index AS id2, {D12} AS pair_distance FROM loc_emb a, loc_emb b WHERE a.cluster_label < 5 AND b.cluster_label >= 5"))
def _(s, d):
    p = loc_emb_2d(s, d)
    return spatial.pair_distances(p.where("cluster_label < 5"), p.where("cluster_label >= 5"))


@query("local_density", sql("SELECT index, " + ", ".join(f"round(count(*) FILTER (d <= {x}) / (pi() * {x} * {x}), 4) AS local_density_{k}" for k, x in enumerate(RADII)) + " FROM loc_emb LEFT JOIN pairs ON i = index GROUP BY index", PAIRS))
def _(s, d):
    out = spatial_stats.local_density(loc_emb_2d(s, d), radii=RADII)
    return r(out, *(f"local_density_{k}" for k in range(len(RADII))), digits=4)


_K = "SELECT radius, 1.0 / (n * (n - 1)) * (SELECT count(*) FROM pairs WHERE d <= radius) AS k FROM (VALUES (0.01), (0.02), (0.03), (0.05)) v(radius), (SELECT count(*) AS n FROM loc_emb)"


def _ripley(s, d):
    return spatial_stats.ripley(loc_emb_2d(s, d), radii=RADII, region_measure=1)


@query("ripley_k", sql(f"SELECT CAST(radius AS DOUBLE) AS radius, round(k, 9) AS ripley_k FROM ({_K})", PAIRS))
def _(s, d):
    return r(_ripley(s, d).select("radius", "ripley_k"), "ripley_k", digits=9)


@query("ripley_l", sql(f"SELECT CAST(radius AS DOUBLE) AS radius, round(sqrt(k / pi()), 9) AS ripley_l FROM ({_K})", PAIRS))
def _(s, d):
    return r(_ripley(s, d).select("radius", "ripley_l"), "ripley_l", digits=9)


@query("ripley_h", sql(f"SELECT CAST(radius AS DOUBLE) AS radius, round(sqrt(k / pi()) - radius, 9) AS ripley_h FROM ({_K})", PAIRS))
def _(s, d):
    return r(_ripley(s, d).select("radius", "ripley_h"), "ripley_h", digits=9)


@query("ripley_h_maximum", sql(f"SELECT CAST(radius AS DOUBLE) AS radius, round(sqrt(k / pi()) - radius, 9) AS ripley_h FROM ({_K}) ORDER BY sqrt(k / pi()) - radius DESC, radius LIMIT 1", PAIRS))
def _(s, d):
    return r(spatial_stats.ripley_h_maximum(_ripley(s, d)), "ripley_h", digits=9)


@query("ripley_k_cross", sql(f"SELECT CAST(radius AS DOUBLE) AS radius, round(1.0 / (n * (m - 1)) * (c - m), 9) AS ripley_k FROM (SELECT radius, (SELECT count(*) FROM loc_emb WHERE cluster_label < 5) AS n, (SELECT count(*) FROM loc_emb WHERE cluster_label >= 5) AS m, (SELECT count(*) FROM loc_emb a, loc_emb b WHERE a.cluster_label < 5 AND b.cluster_label >= 5 AND {D12} <= radius) AS c FROM (VALUES (0.01), (0.02), (0.03), (0.05)) v(radius))"))
def _(s, d):
    p = loc_emb_2d(s, d)
    out = spatial_stats.ripley(p.where("cluster_label < 5"), p.where("cluster_label >= 5"), radii=RADII)
    return r(out.select("radius", "ripley_k"), "ripley_k", digits=9)


@query("localizations_in_hulls")
def _(s, d):
    p = loc_emb_2d(s, d)
    return hulls.localizations_in_hulls(p, p).select("index", "region_id")


@query("localization_property", sql("SELECT frame, intensity FROM loc_li"))
def _(s, d):
    return frames.localization_property(loc_li(s, d), "intensity", "frame")


@query("radial_distribution", sql("SELECT CAST(round(k * 0.01, 6) AS DOUBLE) AS radius, CAST(0.01 AS DOUBLE) AS delta_radius, count(d) AS n, round(count(d) * 2 / ((SELECT count(*) FROM loc_emb) * 500 * pi() * (power((k + 1) * 0.01, 2) - power(k * 0.01, 2))), 6) AS rdf FROM (SELECT unnest(range(0, 6)) AS k) LEFT JOIN (SELECT d FROM pairs WHERE i < j) ON d >= k * 0.01 AND d < (k + 1) * 0.01 GROUP BY k", PAIRS))
def _(s, d):
    out = spatial_stats.radial_distribution(loc_emb_2d(s, d), edges=[k * 0.01 for k in range(7)], density=500)
    return r(out, "radius", "delta_radius", "rdf")


@query("cbc", sql("SELECT p.index, round(CASE WHEN f IS NULL THEN NULL ELSE c * exp(-f / 0.1) END, 8) AS cbc FROM (SELECT index FROM loc_emb WHERE cluster_label < 5) p LEFT JOIN (SELECT i, corr(ra, rb) AS c, max(fb) AS f FROM (SELECT i, fb, rank() OVER wa + (count(*) OVER ea - 1) / 2.0 AS ra, rank() OVER wb + (count(*) OVER eb - 1) / 2.0 AS rb FROM (SELECT a.i, k, round(a.n / (k * k) , 12) AS va, round(b.n / (k * k), 12) AS vb, b.f AS fb FROM ringa a JOIN ringb b USING (i, k)) WINDOW wa AS (PARTITION BY i ORDER BY va), wb AS (PARTITION BY i ORDER BY vb), ea AS (PARTITION BY i, va), eb AS (PARTITION BY i, vb)) GROUP BY i) q ON q.i = p.index", "x AS (SELECT * FROM loc_emb WHERE cluster_label < 5)", "y AS (SELECT * FROM loc_emb WHERE cluster_label >= 5)", f"pa AS (SELECT a.index AS i, {D12} AS d FROM x a, x b WHERE a.index <> b.index)", f"pb AS (SELECT a.index AS i, {D12} AS d FROM x a, y b)", "ringa AS (SELECT i, k, CAST(count(*) FILTER (d < k * 0.01 OR k = 10) AS DOUBLE) AS n FROM pa, (SELECT unnest(range(1, 11)) AS k) WHERE d <= 0.1 GROUP BY i, k)", "ringb AS (SELECT i, k, CAST(count(*) FILTER (d < k * 0.01 OR k = 10) AS DOUBLE) AS n, max(d) AS f FROM pb, (SELECT unnest(range(1, 11)) AS k) WHERE d <= 0.1 GROUP BY i, k)"))
def _(s, d):
    p = loc_emb_2d(s, d)
    return r(spatial_stats.colocalization(p.where("cluster_label < 5"), p.where("cluster_label >= 5"), radius=0.1, n_steps=10), "cbc", digits=8)


@query("localization_precision", sql("SELECT i AS original_index, channel, frame, round(dx, 6) AS position_delta_x, round(abs(dx), 6) AS position_distance FROM (SELECT a.index AS i, a.channel, a.frame, a.position_x - b.position_x AS dx, row_number() OVER (PARTITION BY a.index ORDER BY abs(a.position_x - b.position_x), b.index) AS k FROM loc_ev a JOIN loc_ev b ON b.frame = a.frame + 1 AND a.channel = b.channel AND abs(a.position_x - b.position_x) <= 2 WHERE a.frame < (SELECT max(frame) - 1 FROM loc_ev)) WHERE k = 1"))
def _(s, d):
    return r(frames.localization_precision(loc_ev(s, d), radius=2, by=["channel"]), "position_delta_x", "position_distance")


@query("track")
def _(s, d):
    return frames.link(loc_ev(s, d).select("index", "position_x", "frame", "channel"), search_range=2, memory=1, tile="channel")


# time

@query("localizations_per_frame", sql("SELECT frame, count(*) AS n FROM loc_ev GROUP BY frame"))
def _(s, d):
    return frames.localizations_per_frame(loc_ev(s, d))


@query("localizations_per_frame_resampled", sql("SELECT CAST(frame // 24 * 24 AS BIGINT) AS frame, count(*) AS n FROM loc_ev GROUP BY 1"))
def _(s, d):
    return frames.resampled(frames.localizations_per_frame(loc_ev(s, d)), 24)


@query("accumulation_time", sql("SELECT min(frame) AS accumulation_time FROM (SELECT frame, sum(count(*)) OVER (ORDER BY frame) / sum(count(*)) OVER () AS share FROM loc_ev GROUP BY frame) WHERE share > 0.5"))
def _(s, d):
    return frames.accumulation_time(frames.localizations_per_frame(loc_ev(s, d)))


_F = "f AS (SELECT DISTINCT user_id, frame FROM loc_ev)"
_G = "g AS (SELECT user_id, frame, lag(frame, 1, -1) OVER (PARTITION BY user_id ORDER BY frame) AS b FROM f)"


@query("blink_on_periods", sql("SELECT user_id, min(frame) AS frame, max(frame) - min(frame) + 1 AS period, count(*) AS n_frames FROM (SELECT *, sum(CASE WHEN frame - b > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM g) GROUP BY user_id, run", _F, _G))
def _(s, d):
    return frames.on_periods(loc_ev(s, d), memory=2, by=["user_id"])


@query("blink_off_periods", sql("SELECT user_id, b + 1 AS frame, frame - b - 1 AS period FROM g WHERE frame - b > 3 AND b >= 0", _F, _G))
def _(s, d):
    return frames.off_periods(loc_ev(s, d), memory=2, by=["user_id"])


# scalars and transforms

@query("subpixel_bias", sql("SELECT position_x, position_y, round(position_x - floor(position_x / 256) * 256, 6) AS position_x_modulo, position_y - floor(position_y / 8) * 8 AS position_y_modulo FROM loc_li"))
def _(s, d):
    return r(frames.subpixel_bias(loc_li(s, d).select("position_x", "position_y"), [256, 8]), "position_x_modulo")


@query("uncertainty_model_1", sql("SELECT intensity, 1 / sqrt(intensity) AS uncertainty FROM loc_li"))
def _(s, d):
    return frames.uncertainty(loc_li(s, d).select("intensity"), 1)


@query("uncertainty_model_2", sql("SELECT intensity, position_y AS psf_sigma, position_y / sqrt(intensity) AS uncertainty FROM loc_li"))
def _(s, d):
    return frames.uncertainty(loc_li(s, d).select("intensity", F.col("position_y").alias("psf_sigma")), 2)


@query("uncertainty_model_3", sql("SELECT intensity, psf_sigma, local_background, round(sqrt(sa / intensity * (1 + 4 * t + sqrt(2 * t / (1 + 4 * t)))), 9) AS uncertainty FROM (SELECT *, 2 * pi() * local_background * sa / (intensity * 100) AS t FROM (SELECT intensity, position_y AS psf_sigma, local_background, position_y * position_y + 100 / 12.0 AS sa FROM loc_li))"))
def _(s, d):
    return r(frames.uncertainty(loc_li(s, d).select("intensity", F.col("position_y").alias("psf_sigma"), "local_background"), 3, pixel_size=10), "uncertainty", digits=9)


@query("counts_to_photons", sql("SELECT round((intensity - 100) * 4.5 / 10, 6) AS intensity FROM loc_li"))
def _(s, d):
    return r(transforms.counts_to_photons(loc_li(s, d).select("intensity"), offset=100, gain=10, electrons_per_count=4.5), "intensity")


@query("transform_affine", sql("SELECT index, round(0.5 * (position_x + 1) - 0.25 * (position_y - 2) + 3 - 1, 9) AS position_x, round(0.1 * (position_x + 1) + 2 * (position_y - 2) - 4 + 2, 9) AS position_y FROM loc_emb"))
def _(s, d):
    return r(transforms.transform_affine(loc_emb_2d(s, d), [[0.5, -0.25], [0.1, 2]], [3, -4], [1, -2]).select("index", "position_x", "position_y"), "position_x", "position_y", digits=9)


@query("standardize", sql("SELECT index, round((position_x - avg(position_x) OVER ()) / stddev_pop(position_x) OVER (), 8) AS position_x, round((position_y - avg(position_y) OVER ()) / stddev_pop(position_y) OVER (), 8) AS position_y FROM loc_emb"))
def _(s, d):
    return r(transforms.standardize(loc_emb_2d(s, d)).select("index", "position_x", "position_y"), "position_x", "position_y", digits=8)


@query("overlay", sql("SELECT index, round(position_x - avg(position_x) OVER (PARTITION BY cluster_label), 9) AS position_x, round(position_y - avg(position_y) OVER (PARTITION BY cluster_label), 9) AS position_y FROM loc_emb"))
def _(s, d):
    return r(transforms.overlay(loc_emb_2d(s, d)).select("index", "position_x", "position_y"), "position_x", "position_y", digits=9)


@query("drift_linear_correction", sql("SELECT index, round(position_x - (k * frame + b), 4) AS position_x_corrected FROM loc_ev, (SELECT regr_slope(position_x, frame) AS k, regr_intercept(position_x, frame) AS b FROM loc_ev)"))
def _(s, d):
    return r(transforms.linear_drift_correction(loc_ev(s, d)).select("index", "position_x_corrected"), "position_x_corrected", digits=4)


@query("register_cc")
def _(s, d):
    p = loc_emb_2d(s, d)
    t = transforms.register_cc(p, transforms.transform_affine(p, offset=[-0.06, 0.04]), Bins.of(bin_size=0.02, bin_range=[(-0.6, 0.6)] * 2))
    return s.createDataFrame([(float(t.offset[0]), float(t.offset[1]))], "offset_x double, offset_y double")


@query("register_icp")
def _(s, d):
    p = loc_emb_2d(s, d)
    t = transforms.register_icp(p, transforms.transform_affine(p, offset=[0.002, -0.003]), max_iteration=8)
    return s.createDataFrame([(*map(float, t.matrix.ravel()), *map(float, t.offset))], "m00 double, m01 double, m10 double, m11 double, offset_x double, offset_y double")


@query("drift_estimate_and_apply")
def _(s, d):
    p = loc_emb_2d(s, d).withColumn("frame", F.col("index"))
    chunked = filters.chunks(simulate.add_drift(p, velocity=[0.0002, -0.0001]), order_by="index", n_chunks=4)
    drift = transforms.estimate_drift(chunked, Bins.of(bin_size=0.02, bin_range=[(-0.6, 0.6)] * 2))
    return transforms.apply_drift(chunked, drift).select("index", "position_x", "position_y")


# fits

@query("fit_expon", sql("SELECT min(position_x) AS loc, round(avg(position_x) - min(position_x), 6) AS scale FROM loc_ev"))
def _(s, d):
    return r(distributions.fit_expon(loc_ev(s, d), "position_x"), "scale")


@query("fit_norm", sql("SELECT round(avg(n), 6) AS loc, round(stddev_pop(n), 6) AS scale FROM (SELECT count(*) AS n FROM loc_ev GROUP BY frame)"))
def _(s, d):
    return r(distributions.fit_norm(frames.localizations_per_frame(loc_ev(s, d)), "n"), "loc", "scale")


@query("fit_nn_csr", sql("SELECT round(1 / avg(pi() * d * d), 4) AS density FROM (SELECT i, min(d) AS d FROM pairs GROUP BY i)", PAIRS))
def _(s, d):
    return r(spatial_stats.fit_nearest_neighbor_csr(spatial_stats.nearest_neighbor_distances(loc_emb_2d(s, d))), "density", digits=4)


@query("fit_gauss_2d")
def _(s, d):
    bins = Bins.of(bin_size=0.05, bin_range=[(-0.5, 0.5)] * 2)
    image = binned.histogram(loc_emb_2d(s, d), bins, dense=True).toPandas()  # as many rows as bins
    centers = [np.array(c) for c in bins.bin_centers]
    fit = distributions.fit_gauss_2d(centers[0][image.b0], centers[1][image.b1], image["count"].to_numpy(float))
    return s.createDataFrame([tuple(map(float, fit.values()))], ", ".join(f"{k} double" for k in fit))


@query("pdf_nn_csr", sql(f"SELECT i AS index, round(2 * 100 * pi() * d * exp(-100 * pi() * d * d), 8) AS pdf FROM (SELECT i, min(d) AS d FROM pairs GROUP BY i)", PAIRS))
def _(s, d):
    nn = spatial_stats.nearest_neighbor_distances(loc_emb_2d(s, d))
    return nn.select("index", F.round(distributions.pdf_nn_csr_2d(F.col("nn_distance"), 100), 8).alias("pdf"))


# hulls

@query("convex_hull")
def _(s, d):
    return hulls.convex_hulls(loc_emb_2d(s, d))


@query("max_distance", sql(f"SELECT a.cluster_label, round(max({D12}), 9) AS max_distance FROM loc_emb a JOIN loc_emb b USING (cluster_label) GROUP BY a.cluster_label"))
def _(s, d):
    return r(hulls.convex_hulls(loc_emb_2d(s, d)).select("cluster_label", "max_distance"), "max_distance", digits=9)


@query("alpha_shape")
def _(s, d):
    return hulls.alpha_shapes(hulls.alpha_complex(loc_emb_2d(s, d)), 0.08)


@query("convex_hull_expectation")
def _(s, d):
    return hulls.hull_expectation(hulls.convex_hulls(loc_emb_2d(s, d)), sigma=0.12)


# generators and files

@query("simulate_uniform")
def _(s, d):
    return simulate.simulate_uniform(s, 500, regions.Ellipse((0, 0), 2, 1, 20), seed=3)


@query("simulate_thomas")
def _(s, d):
    return simulate.simulate_thomas(s, 50, ((0, 1), (0, 1)), cluster_mu=8, cluster_std=0.01, seed=3)


@query("simulate_matern")
def _(s, d):
    return simulate.simulate_matern(s, 50, ((0, 1), (0, 1)), cluster_mu=8, radius=0.02, seed=3)


@query("simulate_dstorm")
def _(s, d):
    return simulate.simulate_dstorm(s, 50, ((0, 1), (0, 1)), cluster_mu=8, min_points=2, cluster_std=0.01, seed=3)


@query("simulate_tracks")
def _(s, d):
    return simulate.simulate_tracks(s, 5, 20, seed=3)


@query("simulate_frame_numbers")
def _(s, d):
    return simulate.simulate_frame_numbers(s, 500, 3.0, seed=3)


@query("resample")
def _(s, d):
    return simulate.resample(loc_emb_2d(s, d).withColumn("uncertainty", F.lit(0.01)), 5, seed=3)


@query("randomize")
def _(s, d):
    return simulate.randomize(loc_emb_2d(s, d), seed=3)


@query("files_catalogue", "SELECT file_path, \"group\" FROM (VALUES ('a/x.txt', 'txt'), ('a/y.csv', NULL), ('b/z.txt', 'txt')) v(file_path, \"group\")")
def _(s, d):
    f = files.from_paths(s, ["a/x.txt", "a/y.csv", "b/z.txt", "b/skip.txt"])
    return files.set_group(files.exclude(f, ["skip"]), "txt", glob="*.txt").select("file_path", "group")
