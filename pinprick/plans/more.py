"""More named queries: regions, bins, images, fits, datasets, hulls, generators, files; each with its SQL."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..analysis import Analysis, Pipeline, Roi, roi_from_legacy
from ..dataset import LocSet
from ..functions import distributions, regions, rotations
from ..functions.binning import Bins
from ..operators import binned, clustering, filters, frames, hulls, likelihood, properties, simulate, spatial_hulls, spatial_stats, transforms
from ..operators.components import work_dir
from ..sources import files, native, text
from .catalog import ORACLE_SQL, PAIRS, QUERIES, query, r
from .views import loc_emb, loc_emb_2d, loc_ev, loc_li, sql

# regions

_RECT = regions.AxisOrientedRectangle((-0.1, -0.05), 0.2, 0.2)
_ELLIPSE = regions.Ellipse((0, 0), 0.3, 0.16, 30)
_IN_RECT = "(position_x >= -0.1 AND position_x < 0.1 AND position_y >= -0.05 AND position_y < 0.15)"
_IN_ELLIPSE = "(power((position_x * cos(radians(30)) + position_y * sin(radians(30))) / 0.15, 2) + power((position_y * cos(radians(30)) - position_x * sin(radians(30))) / 0.08, 2) < 1)"


def _square(x: float, y: float, a: float) -> regions.Polygon:
    return regions.Polygon(((x, y), (x, y + a), (x + a, y + a), (x + a, y)))


def _inside(name: str, region, where: str, columns: tuple[str, ...] = ()) -> None:
    """A query of the ids inside a region."""

    @query(name, sql(f"SELECT index FROM loc_emb WHERE {where}"))
    def _(s, d):
        return filters.select_by_region(loc_emb(s, d), region, list(columns) or None).select("index")


_TURN = "(position_x + 0.1) * cos(radians(30)) + (position_y + 0.05) * sin(radians(30)) AS u, (position_y + 0.05) * cos(radians(30)) - (position_x + 0.1) * sin(radians(30)) AS v"
_inside("region_interval", regions.Interval(-0.05, 0.1), "position_x >= -0.05 AND position_x < 0.1", ("position_x",))
_inside("region_rectangle_turned", regions.Rectangle((-0.1, -0.05), 0.2, 0.1, 30), f"index IN (SELECT index FROM (SELECT index, {_TURN} FROM loc_emb) WHERE u >= 0 AND u < 0.2 AND v >= 0 AND v < 0.1)")
_inside("region_cuboid", regions.AxisOrientedCuboid((-0.2, -0.2, -0.2), 0.4, 0.3, 0.25), "position_x >= -0.2 AND position_x < 0.2 AND position_y >= -0.2 AND position_y < 0.1 AND position_z >= -0.2 AND position_z < 0.05")
_inside("region_cuboid_turned", regions.Cuboid((-0.1, -0.05, -0.2), 0.2, 0.1, 0.3, alpha=30), f"index IN (SELECT index FROM (SELECT index, position_z, {_TURN} FROM loc_emb) WHERE u >= 0 AND u < 0.2 AND v >= 0 AND v < 0.1 AND position_z >= -0.2 AND position_z < 0.1)")
_inside("region_hypercuboid", regions.AxisOrientedHypercuboid((-0.2, -0.25, -0.3), (0.3, 0.3, 0.3)), "position_x >= -0.2 AND position_x < 0.1 AND position_y >= -0.25 AND position_y < 0.05 AND position_z >= -0.3 AND position_z < 0")
_inside("region_multipolygon", regions.MultiPolygon((_square(-0.2, -0.2, 0.15), _square(0.05, 0.05, 0.2))), "(position_x > -0.2 AND position_x < -0.05 AND position_y > -0.2 AND position_y < -0.05) OR (position_x > 0.05 AND position_x < 0.25 AND position_y > 0.05 AND position_y < 0.25)")
_inside("region_empty", regions.EmptyRegion(2), "false")
_inside("region_line_segment", regions.LineSegment(((-0.3, -0.1), (0.3, 0.2))), "abs(sqrt(power(position_x + 0.3, 2) + power(position_y + 0.1, 2)) + sqrt(power(position_x - 0.3, 2) + power(position_y - 0.2, 2)) - sqrt(0.45)) <= 1e-8 + 1e-5 * sqrt(0.45)")
_inside("regions_union", regions.regions_union([_RECT, _ELLIPSE]), f"{_IN_RECT} OR {_IN_ELLIPSE}")
_inside("regions_intersection", regions.Intersection(_RECT, _ELLIPSE), f"{_IN_RECT} AND {_IN_ELLIPSE}")
_inside("regions_symmetric_difference", regions.symmetric_difference(_RECT, _ELLIPSE), f"{_IN_RECT} <> {_IN_ELLIPSE}")
_inside("region_expanded", regions.expand_region(_RECT, 0.05, regions.AxisOrientedRectangle((-0.5, -0.5), 0.6, 1)), "position_x >= -0.15000000000000002 AND position_x < 0.1 AND position_y >= -0.1 AND position_y < 0.2")
_inside("region_surrounding", regions.surrounding_region(_RECT, 0.05), f"position_x >= -0.15000000000000002 AND position_x < 0.15000000000000002 AND position_y >= -0.1 AND position_y < 0.2 AND NOT {_IN_RECT}")
_inside("region_from_intervals", regions.region_from_intervals([(-0.1, 0.05), (0, 0.3)]), "position_x >= -0.1 AND position_x < 0.05 AND position_y >= 0 AND position_y < 0.3")

_ARROW = ((-0.2, -0.15), (0.25, 0.0), (-0.2, 0.2), (-0.05, 0.0))
_SIDES = "side(x0, y0, x1, y1) AS (VALUES " + ", ".join(f"({a}, {b}, {c}, {e})" for (a, b), (c, e) in zip(_ARROW, _ARROW[1:] + _ARROW[:1])) + ")"
_NEAR = "seen AS (SELECT index, position_x AS x, position_y AS y, *, greatest(0, least(1, ((position_x - x0) * (x1 - x0) + (position_y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) AS t FROM (SELECT index, position_x, position_y, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM loc_emb, side)), held AS (SELECT index, count(*) FILTER ((y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0) % 2 = 1 AS inside, min(sqrt(power(x - x0 - t * (x1 - x0), 2) + power(y - y0 - t * (y1 - y0), 2))) AS d FROM seen GROUP BY index)"


@query("region_buffered", sql("SELECT index FROM held WHERE inside OR d <= 0.04", f"{_SIDES}, {_NEAR}"))
def _(s, d):
    return filters.select_by_region(loc_emb(s, d), regions.Polygon(_ARROW).buffer(0.04)).select("index")


@query("region_around_polygon", sql("SELECT index FROM held JOIN loc_emb USING (index) WHERE NOT inside AND d <= 0.04 AND position_x < 0.1 AND position_x >= -0.5 AND position_y >= -0.5 AND position_y < 0.5", f"{_SIDES}, {_NEAR}"))
def _(s, d):
    around = regions.surrounding_region(regions.Polygon(_ARROW), 0.04, regions.AxisOrientedRectangle((-0.5, -0.5), 0.6, 1))
    return filters.select_by_region(loc_emb(s, d), around).select("index")


_MEASURED = {
    "interval": (regions.Interval(1, 4), "3"), "rectangle": (regions.Rectangle((1, 2), 3, 4, 20), "12"), "ellipse": (regions.Ellipse((1, 1), 4, 2, 30), "2 * pi()"), "polygon": (regions.Polygon(((0, 0), (0, 4), (3, 0))), "6"),
    "multipolygon": (regions.MultiPolygon((_square(0, 0, 2), _square(5, 5, 3))), "13"), "line_segment": (regions.LineSegment(((0, 0, 0), (2, 3, 6))), "7"), "cuboid": (regions.Cuboid((0, 0, 0), 2, 3, 4, 10, 20, 30), "24"),
    "hypercuboid": (regions.AxisOrientedHypercuboid((0, 0, 0, 0), (1, 2, 3, 4)), "24"), "clipped": (regions.clip_convex(((0, 0), (0, 2), (2, 2), (2, 0)), ((1, 1), (1, 3), (3, 3), (3, 1))), "1"),
    "intersection": (regions.Intersection(_square(0, 0, 2), _square(1, 1, 2)), "1"),
}


@query("region_measures", "SELECT name, round(CAST(measure AS DOUBLE), 9) AS measure FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, (_, v) in _MEASURED.items()) + ", ('union', 7)) v(name, measure)")
def _(s, d):
    rows = [(k, round(float(v.region_measure), 9)) for k, (v, _) in _MEASURED.items()]
    return s.createDataFrame([*rows, ("union", regions.union_measure(_square(0, 0, 2), _square(1, 1, 2)))], "name string, measure double")


@query("distance_to_region_boundary", sql("SELECT index, round(CASE WHEN abs(position_x) < 0.1 AND abs(position_y) < 0.1 THEN 0.1 - greatest(abs(position_x), abs(position_y)) ELSE sqrt(power(greatest(abs(position_x) - 0.1, 0), 2) + power(greatest(abs(position_y) - 0.1, 0), 2)) END, 8) AS distance FROM loc_emb"))
def _(s, d):
    return r(properties.distance_to_region_boundary(loc_emb_2d(s, d), _square(-0.1, -0.1, 0.2)).select("index", "distance"), "distance", digits=8)


@query("roi_select", sql(f"SELECT index FROM loc_emb WHERE {_IN_RECT}"))
def _(s, d):
    return Roi(_RECT, "embeddings", ("position_x", "position_y")).select(loc_emb_2d(s, d)).select("index")


@query("roi_legacy_select", sql(f"SELECT index FROM loc_emb WHERE {_IN_ELLIPSE}"))
def _(s, d):
    return roi_from_legacy("ellipse", ((0, 0), 0.3, 0.16, 30)).select(loc_emb_2d(s, d)).select("index")


# bins and images

@query("bin_centers", sql("SELECT b0, round(-0.5 + (b0 + 0.5) * 0.125, 9) AS center, count(*) AS count FROM (SELECT CAST(floor((position_x + 0.5) / 0.125) AS INTEGER) AS b0 FROM loc_emb WHERE position_x >= -0.5 AND position_x < 0.5) GROUP BY b0"))
def _(s, d):
    bins = Bins.of(n_bins=8, bin_range=(-0.5, 0.5))
    return r(binned.histogram(loc_emb_2d(s, d), bins, ["position_x"]).withColumn("center", bins.center(0, F.col("b0"))), "center", digits=9)


@query("bins_equalized", sql("SELECT CAST(floor((position_x + 0.5) / 0.25) AS INTEGER) AS b0, count(*) AS count FROM loc_emb WHERE position_x >= -0.5 AND position_x < 0.5 GROUP BY 1"))
def _(s, d):
    return binned.histogram(loc_emb_2d(s, d), Bins.of(bin_edges=[-0.5, -0.25, 0.1, 0.5]).equalize_bin_size(), ["position_x"])


@query("bins_oversize", sql("SELECT 0 AS b0, count(*) AS count FROM loc_emb WHERE position_x >= -0.1 AND position_x < 0.1"))
def _(s, d):
    return binned.histogram(loc_emb_2d(s, d), Bins.of(bin_size=10, bin_range=(-0.1, 0.1)), ["position_x"])


@query("histogram_data_range", sql("SELECT CAST(floor((position_x - lo) / ((hi - lo) / 12)) AS INTEGER) AS b0, count(*) AS count FROM loc_li, (SELECT min(position_x) AS lo, max(position_x) AS hi FROM loc_li) WHERE position_x < hi GROUP BY 1"))
def _(s, d):
    li = loc_li(s, d)
    return binned.histogram(li, Bins.over(li, ["position_x"], n_bins=12), ["position_x"])


@query("histogram_zero_range", sql("SELECT CAST(floor(position_x / (hi / 12)) AS INTEGER) AS b0, count(*) AS count FROM loc_li, (SELECT max(position_x) AS hi FROM loc_li) WHERE position_x >= 0 AND position_x < hi GROUP BY 1"))
def _(s, d):
    li = loc_li(s, d)
    return binned.histogram(li, Bins.over(li, ["position_x"], "zero", n_bins=12), ["position_x"])


_BINS = Bins.of(n_bins=6, bin_range=[(-0.3, 0.3), (-0.3, 0.3)])
_IMAGE = "image AS (SELECT b0, b1, CAST(count(n) AS DOUBLE) AS value FROM (SELECT unnest(range(6)) AS b0), (SELECT unnest(range(6)) AS b1) LEFT JOIN (SELECT 1 AS n, floor((position_x + 0.3) / 0.09999999999999999) AS c0, floor((position_y + 0.3) / 0.09999999999999999) AS c1 FROM loc_emb WHERE position_x < 0.3 AND position_y < 0.3) ON c0 = b0 AND c1 = b1 GROUP BY b0, b1)"


def _image(s, d):
    return binned.histogram(loc_emb_2d(s, d), _BINS, dense=True).select("b0", "b1", F.col("count").cast("double").alias("value"))


def _pixels(name: str, values: str, make) -> None:
    """A query of an image, its values from SQL over ``image`` (b0, b1, value)."""

    @query(name, sql(f"SELECT CAST(b0 AS INTEGER) AS b0, CAST(b1 AS INTEGER) AS b1, round({values}, 8) AS value FROM image", _IMAGE.replace("FROM loc_emb", "FROM loc_emb ")))
    def _(s, d):
        return r(make(_image(s, d)).select("b0", "b1", "value"), "value", digits=8)


_LIFT = "(value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ())"
_pixels("image_dense", "value", lambda image: image)
_pixels("image_from_bins", "CAST(3 AS DOUBLE)", lambda image: binned.image_from_bins(image.sparkSession, _BINS, 3))
_pixels("image_contrast", f"0.2 + {_LIFT} * 0.6", lambda image: binned.adjust_contrast(image, "value", 0.2, 0.8))
_pixels("image_standardize", _LIFT, lambda image: binned.transform_intensity(image, "standardize"))
_pixels("image_zero", "value / max(value) OVER ()", lambda image: binned.transform_intensity(image, "zero"))
_pixels("image_equalize_all", "CAST(count(*) OVER (ORDER BY value) AS DOUBLE) / 36", lambda image: binned.transform_intensity(image, "equalize_all"))
_pixels("image_window", "value * " + " * ".join(f"(CASE WHEN least({b} / 5.0, 1 - {b} / 5.0) < 0.25 THEN (1 - cos(2 * pi() * least({b} / 5.0, 1 - {b} / 5.0) / 0.5)) / 2 ELSE 1 END)" for b in ("b0", "b1")), lambda image: binned.apply_window(image, _BINS))


@query("render_rgb", sql("SELECT channel, CAST(floor((position_x - 0.5) / 5000) AS INTEGER) AS b0, CAST(floor((position_y - 0.5) / 10) AS INTEGER) AS b1, count(*) AS count FROM loc_li WHERE position_x >= 0.5 AND position_x < 60000.5 AND position_y >= 0.5 AND position_y < 50.5 GROUP BY 1, 2, 3"))
def _(s, d):
    return binned.render_rgb(loc_li(s, d), Bins.of(bin_size=[5000, 10], bin_range=[(0.5, 60000.5), (0.5, 50.5)]))


# laws and fits

@query("pdf_nn_csr_3d", sql("SELECT i AS index, round(4 * pi() * 100 * d * d * exp(-4.0 / 3 * pi() * 100 * d * d * d), 8) AS pdf FROM (SELECT i, min(d) AS d FROM pairs GROUP BY i)", PAIRS))
def _(s, d):
    nn = spatial_stats.nearest_neighbor_distances(loc_emb_2d(s, d))
    return nn.select("index", F.round(distributions.pdf_nn_csr_3d(F.col("nn_distance"), 100), 8).alias("pdf"))


_S2 = "(0.5 * 0.5 + 0.3 * 0.3)"


@query("pdf_pairwise", sql(f"SELECT index, round(sqrt(2 / pi()) / sqrt({_S2}) * exp(-(0.04 + x * x) / (2 * {_S2})) * cosh(x * 0.2 / {_S2}), 8) AS p1, round(sqrt(2 / pi()) / sqrt({_S2}) * x / 0.2 * exp(-(0.04 + x * x) / (2 * {_S2})) * sinh(x * 0.2 / {_S2}), 8) AS p3, round(exp(-x * x / 1) / (sqrt(pi()) * 0.5), 8) AS z1, round(x / 0.5 * exp(-x * x), 8) AS z2, round(x * x / (2 * sqrt(pi()) * 0.125) * exp(-x * x), 8) AS z3 FROM (SELECT index, abs(position_x) AS x FROM loc_emb)"))
def _(s, d):
    x = F.abs("position_x")
    p = {"p1": distributions.pdf_pairwise_1d(x, 0.2, 0.5, 0.3), "p3": distributions.pdf_pairwise_3d(x, 0.2, 0.5, 0.3)} | {f"z{k}": distributions.pdf_pairwise_zero_mu(x, 0.5, k) for k in (1, 2, 3)}
    return loc_emb_2d(s, d).select("index", *(F.round(v, 8).alias(k) for k, v in p.items()))


@query("gauss_2d", sql("SELECT index, round(3 * exp(-(power((position_x - 0.1) / 0.2, 2) + power((position_y + 0.1) / 0.3, 2)) / 2), 8) AS value FROM loc_emb"))
def _(s, d):
    return loc_emb_2d(s, d).select("index", F.round(distributions.gauss_2d(F.col("position_x"), F.col("position_y"), 3, 0.1, -0.1, 0.2, 0.3), 8).alias("value"))


@query("fit_pairwise_sigma", sql("SELECT round(sqrt(avg(d * d) / 2), 8) AS sigma FROM (SELECT i, min(d) AS d FROM pairs GROUP BY i)", PAIRS))
def _(s, d):
    return r(distributions.fit_pairwise_sigma(spatial_stats.nearest_neighbor_distances(loc_emb_2d(s, d)), "nn_distance"), "sigma", digits=8)


@query("radial_distribution_batch", sql("SELECT CAST(t AS INTEGER) AS dataset_id, CAST(round(k * 0.02, 6) AS DOUBLE) AS radius, CAST(0.02 AS DOUBLE) AS delta_radius, count(d) AS n, round(count(d) * 2 / ((SELECT count(*) FROM loc_emb WHERE (cluster_label >= 5) = (t = 1)) * (t + 1) * 100 * pi() * (power((k + 1) * 0.02, 2) - power(k * 0.02, 2))), 6) AS rdf FROM (SELECT unnest(range(0, 4)) AS k), (SELECT unnest(range(0, 2)) AS t) LEFT JOIN (SELECT sqrt(power(a.position_x - b.position_x, 2) + power(a.position_y - b.position_y, 2)) AS d, a.cluster_label >= 5 AS high FROM loc_emb a JOIN loc_emb b ON a.index < b.index AND (a.cluster_label >= 5) = (b.cluster_label >= 5)) ON d >= k * 0.02 AND d < (k + 1) * 0.02 AND high = (t = 1) GROUP BY t, k"))
def _(s, d):
    p = loc_emb_2d(s, d)
    out = spatial_stats.radial_distribution_batch([p.where("cluster_label < 5"), p.where("cluster_label >= 5")], edges=[k * 0.02 for k in range(5)], densities=[100, 200])
    return r(out, "radius", "delta_radius", "rdf")


# transforms

@query("transform_rotation", sql("SELECT index, round(position_x * cos(radians(40)) - position_y * sin(radians(40)), 9) AS position_x, round(position_x * sin(radians(40)) + position_y * cos(radians(40)), 9) AS position_y FROM loc_emb"))
def _(s, d):
    return r(transforms.transform_affine(loc_emb_2d(s, d), transforms.rotation_2d(math.radians(40))).select("index", "position_x", "position_y"), "position_x", "position_y", digits=9)


@query("overlay_boxes", sql("SELECT index, round(position_x - (min(position_x) OVER g + max(position_x) OVER g) / 2, 9) AS position_x, round(position_y - (min(position_y) OVER g + max(position_y) OVER g) / 2, 9) AS position_y FROM loc_emb WINDOW g AS (PARTITION BY cluster_label)"))
def _(s, d):
    return r(transforms.overlay(loc_emb_2d(s, d), centers="bounding_box").select("index", "position_x", "position_y"), "position_x", "position_y", digits=9)


@query("overlay_turned", sql("SELECT index, round(u * cos(t) + v * sin(t), 7) AS position_x, round(v * cos(t) - u * sin(t), 7) AS position_y FROM (SELECT index, position_x - avg(position_x) OVER g AS u, position_y - avg(position_y) OVER g AS v, atan2(2 * covar_samp(position_x, position_y) OVER g, var_samp(position_x) OVER g - var_samp(position_y) OVER g) / 2 AS t FROM loc_emb WINDOW g AS (PARTITION BY cluster_label))"))
def _(s, d):
    return r(transforms.overlay(loc_emb_2d(s, d), orientation="inertia").select("index", "position_x", "position_y"), "position_x", "position_y", digits=7)


@query("add_drift", sql("SELECT index, round(position_x + frame * 0.25, 6) AS position_x FROM loc_ev"))
def _(s, d):
    return r(simulate.add_drift(loc_ev(s, d).where("frame >= 0"), velocity=[0.25]).select("index", "position_x"), "position_x")


@query("chunk_transforms", sql("SELECT index, round(position_x + c * 0.5 - 1, 6) AS position_x FROM (SELECT index, position_x, (row_number() OVER (ORDER BY index) - 1) % 4 AS c FROM loc_ev)"))
def _(s, d):
    drift = [(0.0, transforms.Transformation(None, [k * 0.5 - 1])) for k in range(4)]
    return r(transforms.apply_chunk_transforms(filters.chunks(loc_ev(s, d), order_by="index", n_chunks=4, order="alternating"), drift).select("index", "position_x"), "position_x")


# clusters and hulls

_DBSCAN = ORACLE_SQL["cluster_dbscan"]
_SWEEP = " UNION ALL ".join(
    f"SELECT CAST({e} AS DOUBLE) AS parameter_eps, {m} AS parameter_min_samples, count(DISTINCT CASE WHEN cluster_label > 0 THEN cluster_label END) AS n_clusters, count(*) FILTER (cluster_label < 0) AS n_noise FROM ({_DBSCAN.replace('d <= 0.02', f'd <= {e}').replace('count(*) >= 4', f'count(*) >= {m - 1}')})"
    for e in (0.015, 0.02) for m in (4, 5)
)
ORACLE_SQL["serial_clustering"] = _SWEEP

#: Directed edges with every other point of the group on their left: the hull, counter-clockwise.
_EDGES = "edges AS (SELECT a.cluster_label, a.position_x AS x0, a.position_y AS y0, b.position_x AS x1, b.position_y AS y1 FROM loc_emb a JOIN loc_emb b ON a.cluster_label = b.cluster_label AND a.index <> b.index WHERE NOT EXISTS (SELECT 1 FROM loc_emb c WHERE c.cluster_label = a.cluster_label AND (b.position_x - a.position_x) * (c.position_y - a.position_y) - (b.position_y - a.position_y) * (c.position_x - a.position_x) < 0))"
_BOXES = "boxes AS (SELECT e.cluster_label, atan2(e.y1 - e.y0, e.x1 - e.x0) AS t, max(p.position_x * cos(atan2(e.y1 - e.y0, e.x1 - e.x0)) + p.position_y * sin(atan2(e.y1 - e.y0, e.x1 - e.x0))) - min(p.position_x * cos(atan2(e.y1 - e.y0, e.x1 - e.x0)) + p.position_y * sin(atan2(e.y1 - e.y0, e.x1 - e.x0))) AS w, max(p.position_y * cos(atan2(e.y1 - e.y0, e.x1 - e.x0)) - p.position_x * sin(atan2(e.y1 - e.y0, e.x1 - e.x0))) - min(p.position_y * cos(atan2(e.y1 - e.y0, e.x1 - e.x0)) - p.position_x * sin(atan2(e.y1 - e.y0, e.x1 - e.x0))) AS h FROM edges e JOIN loc_emb p USING (cluster_label) GROUP BY ALL)"
ORACLE_SQL["localizations_in_hulls"] = sql("SELECT p.index, e.cluster_label AS region_id FROM loc_emb p, edges e GROUP BY p.index, e.cluster_label HAVING min((e.x1 - e.x0) * (p.position_y - e.y0) - (e.y1 - e.y0) * (p.position_x - e.x0)) >= 0", _EDGES)


@query("hull_measures", sql("SELECT cluster_label, count(*) AS n_vertices_ch, round(sum(x0 * y1 - x1 * y0) / 2, 8) AS region_measure_ch, round(sum(sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1))), 8) AS subregion_measure_ch FROM edges GROUP BY cluster_label", _EDGES))
def _(s, d):
    return r(hulls.convex_hulls(loc_emb_2d(s, d)).select("cluster_label", "n_vertices_ch", "region_measure_ch", "subregion_measure_ch"), "region_measure_ch", "subregion_measure_ch", digits=8)


@query("oriented_boxes", sql("SELECT cluster_label, round(min(w * h), 8) AS region_measure_obb, round(greatest(arg_min(w, w * h), arg_min(h, w * h)), 7) AS length_obb, round(least(arg_min(w, w * h), arg_min(h, w * h)), 7) AS width_obb FROM boxes GROUP BY cluster_label", _EDGES, _BOXES))
def _(s, d):
    return r(r(hulls.convex_hulls(loc_emb_2d(s, d)).select("cluster_label", "region_measure_obb", "length_obb", "width_obb"), "region_measure_obb", digits=8), "length_obb", "width_obb", digits=7)


@query("localizations_in_boxes", sql("SELECT p.index, g.cluster_label AS region_id FROM loc_emb p JOIN (SELECT cluster_label, min(position_x) AS x0, max(position_x) AS x1, min(position_y) AS y0, max(position_y) AS y1 FROM loc_emb GROUP BY cluster_label) g ON p.position_x BETWEEN x0 AND x1 AND p.position_y BETWEEN y0 AND y1"))
def _(s, d):
    p = loc_emb_2d(s, d)
    return hulls.localizations_in_hulls(p, p, hull="bounding_box").select("index", "region_id")


#: Triangles of a group with every other point on one side: the faces of the hull in space, their unit normals turned outwards.
_TRIPLES = "triples AS (SELECT a.cluster_label, a.index AS i, b.index AS j, c.index AS k, a.position_x AS x, a.position_y AS y, a.position_z AS z, (b.position_y - a.position_y) * (c.position_z - a.position_z) - (b.position_z - a.position_z) * (c.position_y - a.position_y) AS nx, (b.position_z - a.position_z) * (c.position_x - a.position_x) - (b.position_x - a.position_x) * (c.position_z - a.position_z) AS ny, (b.position_x - a.position_x) * (c.position_y - a.position_y) - (b.position_y - a.position_y) * (c.position_x - a.position_x) AS nz FROM loc_emb a JOIN loc_emb b ON a.cluster_label = b.cluster_label AND a.index < b.index JOIN loc_emb c ON a.cluster_label = c.cluster_label AND b.index < c.index)"
_FACES = "faces AS MATERIALIZED (SELECT cluster_label, i, j, k, x, y, z, size / 2 AS area, turn * nx / size AS nx, turn * ny / size AS ny, turn * nz / size AS nz FROM (SELECT t.cluster_label, i, j, k, x, y, z, nx, ny, nz, sqrt(nx * nx + ny * ny + nz * nz) AS size, CASE WHEN max(side) <= 0 THEN 1 ELSE -1 END AS turn FROM (SELECT t.*, nx * (p.position_x - x) + ny * (p.position_y - y) + nz * (p.position_z - z) AS side FROM triples t JOIN loc_emb p ON p.cluster_label = t.cluster_label AND p.index NOT IN (i, j, k)) t GROUP BY t.cluster_label, i, j, k, x, y, z, nx, ny, nz HAVING max(side) <= 0 OR min(side) >= 0))"
_CORNERS = "corners AS MATERIALIZED (SELECT DISTINCT f.cluster_label, position_x AS px, position_y AS py, position_z AS pz, index FROM faces f JOIN loc_emb p ON p.index IN (f.i, f.j, f.k))"
#: Boxes with a side on a face and another along the line of any two corners, seen along the face's normal.
_SOLID_BOXES = "turned AS (SELECT f.cluster_label, f.i, f.j, f.k, a.index AS a, b.index AS b, nx, ny, nz, b.px - a.px - d * nx AS ux, b.py - a.py - d * ny AS uy, b.pz - a.pz - d * nz AS uz FROM faces f JOIN corners a ON a.cluster_label = f.cluster_label JOIN corners b ON b.cluster_label = f.cluster_label AND a.index < b.index, LATERAL (SELECT (b.px - a.px) * nx + (b.py - a.py) * ny + (b.pz - a.pz) * nz AS d)), solid_boxes AS (SELECT t.cluster_label, max(px * nx + py * ny + pz * nz) - min(px * nx + py * ny + pz * nz) AS h, (max(px * ux + py * uy + pz * uz) - min(px * ux + py * uy + pz * uz)) / max(sqrt(ux * ux + uy * uy + uz * uz)) AS l, (max(px * (ny * uz - nz * uy) + py * (nz * ux - nx * uz) + pz * (nx * uy - ny * ux)) - min(px * (ny * uz - nz * uy) + py * (nz * ux - nx * uz) + pz * (nx * uy - ny * ux))) / max(sqrt(ux * ux + uy * uy + uz * uz)) AS m FROM turned t JOIN corners p ON p.cluster_label = t.cluster_label GROUP BY t.cluster_label, i, j, k, a, b)"


@query("hull_measures_in_space", sql("SELECT cluster_label, n AS localization_count, count(DISTINCT v) AS n_vertices_ch, round(sum(area * (nx * (x - cx) + ny * (y - cy) + nz * (z - cz))) / 9, 9) AS region_measure_ch, round(sum(area) / 3, 8) AS subregion_measure_ch FROM (SELECT *, unnest([i, j, k]) AS v FROM faces) f JOIN (SELECT cluster_label, count(*) AS n, avg(position_x) AS cx, avg(position_y) AS cy, avg(position_z) AS cz FROM loc_emb GROUP BY cluster_label) c USING (cluster_label) GROUP BY cluster_label, n", _TRIPLES, _FACES))
def _(s, d):
    out = spatial_hulls.convex_hulls_in_space(loc_emb(s, d)).select("cluster_label", "localization_count", "n_vertices_ch", "region_measure_ch", "subregion_measure_ch")
    return r(r(out, "region_measure_ch", digits=9), "subregion_measure_ch", digits=8)


@query("oriented_boxes_in_space", sql("SELECT cluster_label, round(l * m * h, 8) AS region_measure_obb, round(greatest(l, m, h), 7) AS length_obb, round(least(l, m, h), 7) AS height_obb, round(1 - least(l, m, h) / greatest(l, m, h), 7) AS elongation_obb FROM (SELECT cluster_label, min_by(l, l * m * h) AS l, min_by(m, l * m * h) AS m, min_by(h, l * m * h) AS h FROM solid_boxes GROUP BY cluster_label)", _TRIPLES, _FACES, _CORNERS, _SOLID_BOXES))
def _(s, d):
    out = spatial_hulls.convex_hulls_in_space(loc_emb(s, d)).select("cluster_label", "region_measure_obb", "length_obb", "height_obb", "elongation_obb")
    return r(r(out, "region_measure_obb", digits=8), "length_obb", "height_obb", "elongation_obb", digits=7)


@query("localizations_in_space", sql("SELECT p.index, f.cluster_label AS region_id FROM loc_emb p, faces f GROUP BY p.index, f.cluster_label HAVING max(nx * (position_x - x) + ny * (position_y - y) + nz * (position_z - z)) <= 5e-10", _TRIPLES, _FACES))
def _(s, d):
    p = loc_emb(s, d)
    return spatial_hulls.localizations_in_space(p, p).select("index", "region_id")


@query("triangulation_counts", sql("SELECT c.cluster_label, n AS n_points, 3 * n - 3 - h AS n_edges, 2 * n - 2 - h AS n_triangles FROM (SELECT cluster_label, count(*) AS n FROM loc_emb GROUP BY cluster_label) c JOIN (SELECT cluster_label, count(*) AS h FROM edges GROUP BY cluster_label) e ON c.cluster_label = e.cluster_label", _EDGES))
def _(s, d):
    p = loc_emb_2d(s, d)
    kinds = hulls.alpha_complex(p).groupBy("cluster_label").agg(F.count_if(F.col("kind") == "edge").alias("n_edges"), F.count_if(F.col("kind") == "triangle").alias("n_triangles"))
    return p.groupBy("cluster_label").agg(F.count("*").alias("n_points")).join(kinds, "cluster_label")


@query("alpha_shape_of_everything", sql("SELECT cluster_label, round(sum(x0 * y1 - x1 * y0) / 2, 6) AS region_measure_as, round(sum(sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1))), 6) AS subregion_measure_as FROM edges GROUP BY cluster_label", _EDGES))
def _(s, d):
    out = hulls.alpha_shapes(hulls.alpha_complex(loc_emb_2d(s, d)), 1e9)
    return r(out.select("cluster_label", "region_measure_as", "subregion_measure_as"), "region_measure_as", "subregion_measure_as")


# likelihood fits

def _fitted(df, column: str, law: str, **digits: int):
    """Fitted parameters side by side, rounded."""
    found = likelihood.fit_law(df, column, law)
    return found.agg(*(F.round(F.max(F.when(F.col("parameter") == p, F.col("value"))), k).alias(p) for p, k in digits.items()), F.max("n").alias("n"))


_DIGAMMA = "ln(y) - 1 / (2 * y) - 1 / (12 * power(y, 2)) + 1 / (120 * power(y, 4)) - 1 / (252 * power(y, 6)) + 1 / (240 * power(y, 8)) - (" + " + ".join(f"1 / (a + {k})" for k in range(10)) + ")"
_HALVED = f"moments AS (SELECT avg(intensity) AS m, avg(ln(intensity)) AS g, count(*) AS n FROM loc_li), halved(low, high, k) AS (SELECT CAST(1e-3 AS DOUBLE), CAST(1e6 AS DOUBLE), 0 UNION ALL SELECT CASE WHEN ln(a) - ({_DIGAMMA}) > ln(m) - g THEN a ELSE low END, CASE WHEN ln(a) - ({_DIGAMMA}) > ln(m) - g THEN high ELSE a END, k + 1 FROM (SELECT *, sqrt(low * high) AS a, sqrt(low * high) + 10 AS y FROM halved), moments WHERE k < 120)"


@query("fit_gamma", sql("SELECT round(low, 6) AS a, round(m / low, 2) AS scale, n FROM halved, moments WHERE k = 120", _HALVED).replace("WITH", "WITH RECURSIVE", 1))
def _(s, d):
    return _fitted(loc_li(s, d), "intensity", "gamma", a=6, scale=2)


@query("fit_lognormal", sql("SELECT round(stddev_pop(ln(intensity)), 7) AS s, round(exp(avg(ln(intensity))), 2) AS scale, count(*) AS n FROM loc_li"))
def _(s, d):
    return _fitted(loc_li(s, d), "intensity", "lognorm", s=7, scale=2)


@query("fit_pairwise_distance", sql("SELECT round(sqrt(avg(position_x * position_x + position_y * position_y) / 4), 8) AS sigma, count(*) AS n FROM loc_emb"))
def _(s, d):
    return _fitted(loc_emb(s, d).withColumn("d", F.sqrt(F.col("position_x") * F.col("position_x") + F.col("position_y") * F.col("position_y"))), "d", "pairwise_2d_zero_mu", sigma=8)


# datasets and analyses

@query("dataset_centroid", sql("SELECT round(avg(position_x), 9) AS position_x, round(avg(position_y), 9) AS position_y FROM loc_emb"))
def _(s, d):
    return r(LocSet(loc_emb_2d(s, d)).centroid, "position_x", "position_y", digits=9)


@query("dataset_select", sql("SELECT index, position_x FROM loc_emb WHERE position_x > 0"))
def _(s, d):
    p = loc_emb_2d(s, d)
    return LocSet(p).select(p.where("position_x > 0").select("index")).df.select("index", "position_x")


@query("dataset_collection", sql("SELECT CAST(cluster_label >= 5 AS INTEGER) AS collection_id, count(*) AS localization_count, round(avg(position_x), 9) AS position_x, max(frame) AS marked FROM (SELECT *, 7 AS frame FROM loc_emb) GROUP BY 1"))
def _(s, d):
    p = loc_emb_2d(s, d)
    sets = LocSet.collection([LocSet(p.where("cluster_label < 5")), LocSet(p.where("cluster_label >= 5"))])
    new = s.createDataFrame([(0, 7), (1, 7)], "collection_id int, marked int")
    return r(sets.update_properties(new).select("collection_id", "localization_count", "position_x", "marked"), "position_x", digits=9)


@query("dataset_reduce", sql("SELECT index, position_x, position_y FROM loc_emb WHERE position_y > 0"))
def _(s, d):
    return LocSet(loc_emb_2d(s, d)).select(F.col("position_y") > 0).reduce().df.select("index", "position_x", "position_y")


@query("concat_numbers", sql("SELECT index, value FROM (SELECT row_number() OVER (ORDER BY part, i) - 1 AS index, value FROM (SELECT 0 AS part, index AS i, position_x AS value FROM loc_emb UNION ALL SELECT 1, index, position_y FROM loc_emb))"))
def _(s, d):
    p = loc_emb_2d(s, d)
    return filters.concat([p.select("index", F.col("position_x").alias("value")), p.select("index", F.col("position_y").alias("value"))]).select("index", "value")


@query("analysis_compute", sql("SELECT frame, count(*) AS n FROM loc_ev GROUP BY frame"))
def _(s, d):
    return Analysis(frames.localizations_per_frame).compute(loc_ev(s, d)).results


@query("pipeline_compute", sql("SELECT cluster_label, count(*) AS localization_count FROM loc_emb WHERE position_x > 0 GROUP BY cluster_label"))
def _(s, d):
    def steps(self, df):
        self.chosen = filters.select_by_condition(df, "position_x > 0")
        self.result = properties.collection_properties(self.chosen)

    return Pipeline(steps, df=loc_emb_2d(s, d)).compute().result.select("cluster_label", "localization_count")


# generators, by what holds of every row whatever the random numbers

@query("simulated_counts", "SELECT name, CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS n_valid FROM (VALUES ('uniform', 500), ('ellipse', 300), ('tracks', 200), ('frames', 400)) v(name, n)")
def _(s, d):
    square, ellipse = regions.AxisOrientedRectangle((0, 0), 2, 3), regions.Ellipse((0, 0), 2, 1, 20)
    x = [F.col("position_x"), F.col("position_y")]
    count = lambda df, name, ok: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_if(ok).alias("n_valid"))
    out = count(simulate.simulate_uniform(s, 500, square, seed=1), "uniform", square.contains(x))
    out = out.unionByName(count(simulate.simulate_uniform(s, 300, ellipse, seed=1), "ellipse", ellipse.contains(x)))
    out = out.unionByName(count(simulate.simulate_tracks(s, 10, 20, seed=1), "tracks", (F.col("index") == F.col("cluster_label") * 20 + F.col("frame")) & (F.col("frame") < 20)))
    return out.unionByName(count(simulate.simulate_frame_numbers(s, 400, 3.0, seed=1).dropDuplicates(["index"]), "frames", F.col("index").between(0, 399)))


@query("simulated_steps", "SELECT CAST(190 AS BIGINT) AS n, CAST(190 AS BIGINT) AS n_of_one_step")
def _(s, d):
    p = simulate.simulate_tracks(s, 10, 20, diffusion_constant=2, time_step=0.5, seed=1)
    after = p.select("cluster_label", (F.col("frame") - 1).alias("frame"), F.col("position_x").alias("x"), F.col("position_y").alias("y"))
    step = math.sqrt(2 * 2 * 2 * 0.5)
    near = lambda a, b: F.abs(F.abs(F.col(a) - F.col(b)) - step) < 1e-6
    return p.join(after, ["cluster_label", "frame"]).agg(F.count("*").alias("n"), F.count_if(near("x", "position_x") & near("y", "position_y")).alias("n_of_one_step"))


@query("resample_counts", sql("SELECT index AS original_index, CAST(5 AS BIGINT) AS n, CAST(5 AS BIGINT) AS n_distinct FROM loc_emb"))
def _(s, d):
    out = simulate.resample(loc_emb_2d(s, d).withColumn("uncertainty", F.lit(0.01)), 5, seed=3)
    return out.groupBy("original_index").agg(F.count("*").alias("n"), F.countDistinct("index").alias("n_distinct"))


@query("randomize_counts", sql("SELECT count(*) AS n, count(*) AS n_inside FROM loc_emb"))
def _(s, d):
    p = loc_emb_2d(s, d)
    box = p.agg(*(f(c).alias(f"{c}_{k}") for c in ("position_x", "position_y") for k, f in (("lo", F.min), ("hi", F.max))))
    inside = F.col("position_x").between(F.col("position_x_lo"), F.col("position_x_hi") + 1e-9) & F.col("position_y").between(F.col("position_y_lo"), F.col("position_y_hi") + 1e-9)
    return simulate.randomize(p, seed=3).crossJoin(F.broadcast(box)).agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"))  # one row is broadcast


@query("random_subset_counts", "SELECT 'drawn once' AS kind, CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS n_known UNION ALL SELECT 'drawn again', 150, 150")
def _(s, d):
    p = loc_emb_2d(s, d)
    once = filters.random_subset(p, 100, replace=False, seed=7).select("index").distinct()
    again = filters.random_subset(p, 150, replace=True, seed=7).select("index")
    count = lambda df, kind: df.join(p.select("index", F.lit(1).alias("known")), "index", "left").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count("known").alias("n_known"))
    return count(once, "drawn once").unionByName(count(again, "drawn again"))


@query("tracks_are_consistent", sql("SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_far FROM loc_ev"))
def _(s, d):
    from pyspark.sql import Window

    t = frames.link(loc_ev(s, d).select("index", "position_x", "frame", "channel"), search_range=2, memory=1, tile="channel")
    w = Window.partitionBy("channel", "track").orderBy("frame")
    t = t.withColumns({"_f": F.lag("frame").over(w), "_x": F.lag("position_x").over(w)})
    far = (F.col("frame") - F.col("_f") > 2) | (F.abs(F.col("position_x") - F.col("_x")) > 2)
    return t.agg(F.count("*").alias("n"), F.count_if(F.col("frame") == F.col("_f")).alias("n_repeated"), F.count_if(far).alias("n_far"))


@query("hdbscan_cluster_sizes", "SELECT CAST(0 AS BIGINT) AS n_too_small")
def _(s, d):
    labels = clustering.hdbscan(loc_emb_2d(s, d), min_cluster_size=5).where("cluster_label > 0")
    return labels.groupBy("cluster_label").count().agg(F.count_if(F.col("count") < 5).alias("n_too_small"))


_SOLE = "pair AS (SELECT a.index AS a, b.index AS b FROM loc_ev a JOIN loc_ev b ON b.frame = a.frame + 1 AND a.channel = b.channel AND abs(a.position_x - b.position_x) <= 0.5), sole AS (SELECT a, b FROM (SELECT a, b, count(*) OVER (PARTITION BY a) AS n, count(*) OVER (PARTITION BY b) AS m FROM pair) WHERE n = 1 AND m = 1)"


@query("track_sole_links", sql("SELECT a, b FROM sole", _SOLE))
def _(s, d):
    """Links of points that have one candidate only, which has no other: any least assignment holds them."""
    from pyspark.sql import Window

    p = loc_ev(s, d).select("index", "position_x", "frame", "channel")
    t = frames.link(p, search_range=0.5, tile="channel").withColumn("b", F.lead("index").over(Window.partitionBy("channel", "track").orderBy("frame")))
    at = frames.places(p, ["channel", "frame", "position_x"]).withColumn("spot", F.struct("index", "n"))
    near = frames.radius_pairs(at.withColumn("frame", F.col("frame") + 1), at, radius=0.5, id_col="spot", coords=["position_x"], on=["channel", "frame"])
    alone = lambda one, other, name: near.groupBy(F.col(f"{one}.index").alias(name)).agg(F.sum(f"{other}.n").alias("n")).where("n = 1").select(name)
    return t.where("b is not null").select(F.col("index").alias("a"), "b").join(alone("id1", "id2", "a"), "a").join(alone("id2", "id1", "b"), "b").select("a", "b")


_REACH = "radii(radius) AS (VALUES (0.01), (0.02), (0.03)), core AS (SELECT i, d AS c FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS k FROM pairs) WHERE k = 4), near AS (SELECT radius, p.i, p.j FROM pairs p JOIN core a ON a.i = p.i JOIN core b ON b.i = p.j, radii WHERE greatest(d, a.c, b.c) <= radius), reach(radius, a, b) AS (SELECT radius, index, index FROM loc_emb, radii UNION SELECT reach.radius, a, j FROM reach JOIN near ON near.radius = reach.radius AND b = i)"


@query("reachability_components", f"WITH RECURSIVE loc_emb AS (SELECT vec_id AS index, CAST(embedding[1] AS DOUBLE) AS position_x, CAST(embedding[2] AS DOUBLE) AS position_y FROM embeddings), {PAIRS}, {_REACH} SELECT CAST(radius AS DOUBLE) AS radius, count(DISTINCT c) AS n_components FROM (SELECT radius, b, min(a) AS c FROM reach GROUP BY radius, b) GROUP BY radius")
def _(s, d):
    """Components of mutual reachability at three lengths, from the spanning tree of hierarchical clusters."""
    from ..operators.hierarchy import spanning_tree

    p = loc_emb_2d(s, d).select(F.col("index").alias("id"), "position_x", "position_y")
    tree, n = spanning_tree(p, 5, ["position_x", "position_y"]), p.count()
    radii = F.explode(F.array(*(F.lit(x) for x in (0.01, 0.02, 0.03)))).alias("radius")
    return tree.select("w", radii).groupBy("radius").agg((F.lit(n) - F.count_if(F.col("w") <= F.col("radius"))).alias("n_components"))


@query("registration_of_a_shift", "SELECT 'cross_correlation' AS method, -2 AS shift_x, 3 AS shift_y UNION ALL SELECT 'icp', -2, 3")
def _(s, d):
    p = loc_emb_2d(s, d)
    cc = transforms.register_cc(transforms.transform_affine(p, offset=[-0.04, 0.06]), p, Bins.of(bin_size=0.02, bin_range=[(-0.64, 0.64)] * 2))
    icp = transforms.register_icp(p, transforms.transform_affine(p, offset=[-0.0002, 0.0003]), max_iteration=20)
    rows = [("cross_correlation", *(int(round(v / 0.02)) for v in cc.offset)), ("icp", *(int(round(v / 0.0001)) for v in icp.offset))]
    return s.createDataFrame(rows, "method string, shift_x int, shift_y int")


# files

_PATHS = ["a/x.txt", "a/y.csv", "b/z.txt"]


@query("files_matched", "SELECT file_path, other_file_path FROM (VALUES ('a/x.txt', 'm/x.toml'), ('a/y.csv', 'm/y.toml'), ('b/z.txt', NULL)) v(file_path, other_file_path)")
def _(s, d):
    return files.match_files(files.from_paths(s, _PATHS), files.from_paths(s, ["m/x.toml", "m/y.toml"])).select("file_path", "other_file_path")


@query("files_concatenated", "SELECT file_path FROM (VALUES ('a/x.txt'), ('a/y.csv'), ('b/z.txt'), ('c/w.txt')) v(file_path)")
def _(s, d):
    return files.concatenate([files.from_paths(s, _PATHS), files.from_paths(s, ["b/z.txt", "c/w.txt"])]).select("file_path")


@query("files_grouped", "SELECT \"group\", count FROM (VALUES ('a', CAST(2 AS BIGINT)), ('z', CAST(1 AS BIGINT))) v(\"group\", count)")
def _(s, d):
    return files.grouped(files.set_group(files.set_group(files.from_paths(s, _PATHS), "a", pattern="a/"), "z", regex="z[.]txt$"))


@query("files_group_identifiers", "SELECT \"group\" FROM (VALUES ('a')) v(\"group\")")
def _(s, d):
    return files.group_identifiers(files.set_group(files.from_paths(s, _PATHS), "a", pattern="a/"))


@query("files_summary", "SELECT CAST(3 AS BIGINT) AS n_files, CAST(3 AS BIGINT) AS n_unique")
def _(s, d):
    return files.summary(files.from_paths(s, _PATHS))


def _path(s, name: str) -> str:
    return f"{work_dir(s)}/{name}-{uuid.uuid4().hex}"


_LI = "SELECT frame, position_x, position_y, intensity FROM loc_li"


@query("thunderstorm_round_trip", sql(_LI))
def _(s, d):
    path = _path(s, "thunderstorm")
    text.save_thunderstorm_csv(loc_li(s, d).select("frame", "position_x", "position_y", "intensity"), path)
    return text.load(s, path, "thunderstorm").select("frame", "position_x", "position_y", "intensity")


@query("text_round_trip", sql(_LI))
def _(s, d):
    path = _path(s, "text")
    loc_li(s, d).select("frame", "position_x", "position_y", "intensity").write.option("header", True).csv(path)
    return text.load(s, path)


@query("native_round_trip", sql("SELECT index, position_x, position_y, cluster_label FROM loc_emb"))
def _(s, d):
    path = _path(s, "native")
    native.save_native(loc_emb_2d(s, d), path)
    return native.load_native(s, path).select("index", "position_x", "position_y", "cluster_label")


@query("convert_property_types", sql("SELECT frame, position_x, intensity FROM loc_li"))
def _(s, d):
    return text.convert_property_types(loc_li(s, d).select(*(F.col(c).cast("string").alias(c) for c in ("frame", "position_x", "intensity"))))


# drift models, turns, datasets

def _drift(matrix, offset, frames) -> list:
    return [(float(f), transforms.Transformation(matrix(f), offset(f))) for f in frames]


@query("drift_models_linear", sql("SELECT frame, round(position_x * (1 + 0.001 * frame) + 0.5 * frame, 6) AS position_x, round(position_y - 0.002 * frame * position_x - 0.25 * frame, 6) AS position_y FROM loc_li"))
def _(s, d):
    drift = _drift(lambda f: [[1 + 0.001 * f, 0], [-0.002 * f, 1]], lambda f: [0.5 * f, -0.25 * f], range(-1000, 1400, 300))
    models = transforms.fit_drift(drift, matrix_models=["linear", None, "linear", "one"], offset_models=["linear", "linear"])
    return r(transforms.apply_drift_models(loc_li(s, d).select("frame", "position_x", "position_y"), models), "position_x", "position_y", digits=6)


@query("drift_spline", sql("SELECT frame, round(position_x + 1.23456789e-7 * frame * frame * frame - 0.00212345678 * frame * frame, 3) AS position_x, position_y FROM loc_li"))
def _(s, d):
    drift = _drift(lambda f: [[1, 0], [0, 1]], lambda f: [1.23456789e-7 * f**3 - 0.00212345678 * f**2, 0], range(-1200, 1400, 200))
    models = transforms.fit_drift(drift, offset_models=[transforms.DriftComponent("spline", smoothing=-1), None])  # never one cubic alone
    return r(transforms.apply_drift_models(loc_li(s, d).select("frame", "position_x", "position_y"), models), "position_x", digits=3)


@query("drift_basis", sql("SELECT index, round(position_x + 2 * sin(frame / 1000.0) + 0.5 * sqrt(abs(frame)), 4) AS position_x FROM loc_ev"))
def _(s, d):
    lit = lambda on_column, on_number: lambda x: on_column(x) if isinstance(x, Column) else on_number(x)
    wave = transforms.DriftComponent("basis", basis=[lit(lambda x: F.sin(x / 1000.0), lambda x: np.sin(x / 1000)), lit(lambda x: F.sqrt(F.abs(x)), lambda x: np.sqrt(np.abs(x)))])
    drift = _drift(lambda f: [[1]], lambda f: [2 * math.sin(f / 1000) + 0.5 * math.sqrt(f)], range(0, 2000, 100))
    return r(transforms.apply_drift_models(loc_ev(s, d).select("index", "frame", "position_x"), transforms.fit_drift(drift, offset_models=[wave])).drop("frame"), "position_x", digits=4)


@query("rotate_2d_inverse", sql("SELECT index, round((position_x + 1) * cos(radians(-40)) - position_y * sin(radians(-40)), 9) AS position_x, round((position_x + 1) * sin(radians(-40)) + position_y * cos(radians(-40)), 9) AS position_y FROM loc_emb"))
def _(s, d):
    p = loc_emb_2d(s, d).select("index", (F.col("position_x") + 1).alias("position_x"), "position_y")
    return r(rotations.rotate(p, rotations.Rotation2D.from_angle(40, degrees=True).inv()), "position_x", "position_y", digits=9)


@query("rotate_3d", sql("SELECT index, round(-position_y, 9) AS position_x, round(position_x * cos(radians(30)) - position_z * sin(radians(30)), 9) AS position_y, round(position_x * sin(radians(30)) + position_z * cos(radians(30)), 9) AS position_z FROM loc_emb"))
def _(s, d):
    p = loc_emb(s, d).select("index", "position_x", "position_y", "position_z")
    return r(rotations.rotate(p, rotations.Rotation3D.from_euler("zx", [90, 30], degrees=True)), "position_x", "position_y", "position_z", digits=9)


@query("dataset_reset", sql("SELECT row_number() OVER (ORDER BY index) - 1 AS index, position_x FROM loc_emb WHERE position_x > 0"))
def _(s, d):
    return LocSet(loc_emb_2d(s, d)).select(F.col("position_x") > 0).reset(reset_index=True).df.select("index", "position_x")


@query("dataset_with_reference", sql("SELECT index, position_x, position_y, cluster_label, position_x > position_y AS right_of FROM loc_emb WHERE position_x > 0"))
def _(s, d):
    whole = LocSet(loc_emb_2d(s, d))
    own = LocSet(whole.df.where("position_x > 0").select("index", (F.col("position_x") > F.col("position_y")).alias("right_of")))
    return own.data(whole)


@query("simulate_centers", "SELECT CAST(c AS BIGINT) AS cluster_label, CAST(x AS DOUBLE) AS position_x, CAST(y AS DOUBLE) AS position_y FROM (VALUES (0, 1.5, 1.0), (0, 1.0, 1.25), (2, 4.0, 4.5)) v(c, x, y)")
def _(s, d):
    return simulate.simulate_centers(s, [(1, 1), (2, 2), (4, 4)], [(0, 5), (0, 5)], offspring=[[(0.5, 0), (0, 0.25)], [], [(0, 0.5), (2, 0)]]).select("cluster_label", "position_x", "position_y")


assert set(ORACLE_SQL) <= set(QUERIES)
