"""Aggregate properties: one pass of built-in aggregates each."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import check_columns, coordinates, per_dimension

RATIO_FWHM_TO_SIGMA = 2 * math.sqrt(2 * math.log(2))


def weighted_moments(x: Column, w: Column) -> tuple[Column, Column]:
    """(weighted mean, variance of the weighted mean, at least 0) as aggregates of one pass.

    The variance is n / ((n - 1) W^2) * sum w^2 (x - mean)^2 with W the sum of weights, here
    from plain sums; values far from zero should be centred first.
    """
    w = F.when(x.isNotNull(), w)
    n, sw, swx, sw2, sw2x, sw2x2 = F.count(w * x), F.sum(w), F.sum(w * x), F.sum(w * w), F.sum(w * w * x), F.sum(w * w * x * x)
    mean = swx / sw
    spread = sw2x2 - 2 * mean * sw2x + mean * mean * sw2
    return mean, F.when(n > 1, F.greatest(F.lit(0.0), n / ((n - 1) * sw * sw) * spread))


def biased_variance(variance: Column, n: Column) -> Column:
    """Expected variance about the sample mean, v (1 - 1/n)."""
    return variance * (1 - 1 / n)


def statistics(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ("count", "min", "max", "mean", "median", "std", "sem"), by: Sequence[str] = ()) -> DataFrame:
    """``<column>_<statistic>`` for each column; std and sem divide by n - 1. Nulls don't count.

    Without groups, medians come from the rows numbered in order of the column, range by range, so that no task holds all values.
    """
    make = {
        "count": F.count, "min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "std": F.stddev_samp,
        "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)),
    }
    columns = [c for c, t in df.dtypes if t in ("bigint", "int", "double", "float", "smallint", "tinyint")] if columns is None else check_columns(df.columns, columns)
    if by or "median" not in keys:
        return df.groupBy(*by).agg(*(make[k](F.col(c)).alias(f"{c}_{k}") for c in columns for k in keys))
    out = df.agg(F.lit(1).alias("_one"), *(make[k](F.col(c)).alias(f"{c}_{k}") for c in columns for k in keys if k != "median"))
    for c in columns:
        out = out.crossJoin(F.broadcast(_median(df, c)))  # one row is broadcast
    return out.select(*(f"{c}_{k}" for c in columns for k in keys))


def _median(df: DataFrame, column: str) -> DataFrame:
    """One row with the mean of the middle value or the two middle values."""
    from .filters import numbered_rows

    rows = numbered_rows(df.select(F.col(column).cast("double").alias("v")).dropna(), [F.col("v")], "_row")
    n = rows.count()
    return rows.where(F.col("_row").isin((n - 1) // 2, n // 2)).agg(F.avg("v").alias(f"{column}_median"))


def ranges(df: DataFrame, columns: Sequence[str] | None = None, special: str | None = None, epsilon: float = 1) -> DataFrame:
    """One row with ``<column>_min`` and ``<column>_max``.

    special 'zero': every lower end is 0; 'link': all columns share the widest range. A
    range of a single row is widened by ``epsilon`` at its upper end.
    """
    columns = check_columns(df.columns, columns)
    out = df.agg(F.count("*").alias("_n"), *(f(c).cast("double").alias(f"{c}_{k}") for c in columns for k, f in (("min", F.min), ("max", F.max))))
    out = out.withColumns({f"{c}_max": F.when(F.col("_n") == 1, F.col(f"{c}_max") + epsilon).otherwise(F.col(f"{c}_max")) for c in columns})
    if special == "zero":
        out = out.withColumns({f"{c}_min": F.lit(0.0) for c in columns})
    elif special == "link":
        least = F.least(*(F.col(f"{c}_min") for c in columns)) if len(columns) > 1 else F.col(f"{columns[0]}_min")
        most = F.greatest(*(F.col(f"{c}_max") for c in columns)) if len(columns) > 1 else F.col(f"{columns[0]}_max")
        out = out.select(F.col("_n"), least.alias("_lo"), most.alias("_hi")).select("_n", *(F.col(v).alias(f"{c}_{k}") for c in columns for k, v in (("min", "_lo"), ("max", "_hi"))))
    elif special is not None:
        raise ValueError("special is None, 'zero' or 'link'")
    return out.drop("_n")


def range_from_collection(frames: Sequence[DataFrame], columns: Sequence[str] | None = None, special: str | None = None, epsilon: float = 1) -> DataFrame:
    """The range over all frames together."""
    columns = check_columns(frames[0].columns, columns)
    out = frames[0].select(*columns)
    for f in frames[1:]:
        out = out.unionByName(f.select(*columns))
    return ranges(out, columns, special, epsilon)


def collection_properties(df: DataFrame, by: str | Sequence[str] = "cluster_label", id_col: str | None = None) -> DataFrame:
    """One row of properties per group: count; positions weighted by 1/u^2 where the group has
    uncertainties, with their standard error; sum of intensity; mean background; first frame; box measures."""
    by = [by] if isinstance(by, str) else list(by)
    coords, have = coordinates(df.columns), df.columns
    aggs: list[Column] = [F.count("*").alias("localization_count")]
    for c, u in zip(coords, per_dimension(have, "uncertainty")):
        x = F.col(c)
        if u is None:
            aggs += [F.avg(x).alias(c), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias(f"uncertainty_{c[-1]}")]
        else:
            mean, var = weighted_moments(x, 1 / (F.col(u) * F.col(u)))
            alone = F.count(x) == 1
            aggs += [F.when(alone, F.max(x)).otherwise(mean).alias(c), F.when(alone, F.max(u)).otherwise(F.sqrt(var)).alias(f"uncertainty_{c[-1]}")]
    for name, f in (("intensity", F.sum), ("local_background", F.avg), ("frame", F.min)):
        if name in have:
            aggs.append(f(name).alias(name))
    return df.groupBy(*by).agg(*aggs, *_box(coords))


def _box(coords: Sequence[str]) -> list[Column]:
    width = [F.max(c) - F.min(c) for c in coords]
    area = width[0]
    for w in width[1:]:
        area = area * w
    total = width[0]
    for w in width[1:]:
        total = total + w
    return [area.alias("region_measure_bb"), F.when(area != 0, F.count("*") / area).alias("localization_density_bb"), (2 * total).alias("subregion_measure_bb")]


def bounding_box(df: DataFrame, by: Sequence[str] = (), coords: Sequence[str] | None = None) -> DataFrame:
    """Box per group: its ends, measure, density (null if it is flat) and twice the sum of its widths."""
    coords = check_columns(df.columns, coords)
    return df.groupBy(*by).agg(*(f(c).alias(f"{c}_{k}") for c in coords for k, f in (("min", F.min), ("max", F.max))), *_box(coords))


def inertia_moments(df: DataFrame, by: Sequence[str] = (), coords: Sequence[str] | None = None) -> DataFrame:
    """Eigenvalues of the 2 x 2 covariance (n - 1), share of the larger, its direction in degrees, and eccentricity."""
    x, y = check_columns(df.columns, coords)[:2]
    m = df.groupBy(*by).agg(F.var_samp(x).alias("a"), F.covar_samp(x, y).alias("b"), F.var_samp(y).alias("c"))
    mid, root = (F.col("a") + F.col("c")) / 2, F.sqrt((F.col("a") - F.col("c")) * (F.col("a") - F.col("c")) / 4 + F.col("b") * F.col("b"))
    m = m.withColumn("eigenvalue_1", mid + root).withColumn("eigenvalue_2", mid - root)
    angle = F.degrees(F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2)
    return m.select(
        *by, "eigenvalue_1", "eigenvalue_2", (F.col("eigenvalue_1") / (F.col("eigenvalue_1") + F.col("eigenvalue_2"))).alias("explained_1"),
        angle.alias("orientation"), F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("eigenvalue_2") / F.col("eigenvalue_1"))).alias("eccentricity"),
    )


def distance_to_point(df: DataFrame, point: Sequence[float], name: str = "distance") -> DataFrame:
    coords = coordinates(df.columns)
    total = None
    for c, p in zip(coords, point, strict=True):
        d = (F.col(c) - p) * (F.col(c) - p)
        total = d if total is None else total + d
    return df.withColumn(name, F.sqrt(total))


def distance_to_region(df: DataFrame, region, name: str = "distance") -> DataFrame:
    """0 inside the polygon, else the distance to its boundary."""
    x = [F.col(c) for c in coordinates(df.columns)[:2]]
    return df.withColumn(name, F.when(region.contains(x), 0.0).otherwise(region.boundary_distance(x)))


def distance_to_region_boundary(df: DataFrame, region, name: str = "distance") -> DataFrame:
    return df.withColumn(name, region.boundary_distance([F.col(c) for c in coordinates(df.columns)[:2]]))


def property_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations in long form (a, b, correlation), all pairs of columns in one pass."""
    columns = check_columns(df.columns, columns)
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*(F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)))).alias("r")).select("r.*")


def grouped_expectation(df: DataFrame, column: str, by: str, expectation: float | dict | DataFrame | None = None) -> DataFrame:
    """Mean and deviation (n - 1) of ``column`` per group, with what is expected of the group and the ratio to it.

    ``expectation`` is a number, a dict by group, or a frame (group, expectation).
    """
    out = df.groupBy(by).agg(F.avg(column).alias(f"{column}_mean"), F.stddev_samp(column).alias(f"{column}_std"))
    if isinstance(expectation, dict):
        rows = list(expectation.items())
        expectation = df.sparkSession.createDataFrame(rows, f"`{by}` {dict(df.dtypes)[by]}, expectation double")
    if isinstance(expectation, DataFrame):
        out = out.join(expectation, by, "left")
    else:
        out = out.withColumn("expectation", F.lit(expectation).cast("double"))
    return out.withColumn(f"{column}_ratio", F.col(f"{column}_mean") / F.col("expectation"))


def position_variance_expectation(df: DataFrame, column: str, group: str, expectation: float | None = None, biased: bool = True) -> DataFrame:
    """Variance of ``column`` within each group, averaged over groups of equal size, with its expectation
    (less by 1 - 1/n if biased) and the ratio."""
    each = df.groupBy(group).agg(F.count(column).alias("localization_count"), (F.var_pop if biased else F.var_samp)(column).alias("v"))
    out = each.groupBy("localization_count").agg(F.avg("v").alias(f"{column}_var_mean"), F.stddev_samp("v").alias(f"{column}_var_std"), F.count("*").alias("n_groups"))
    expected = F.lit(expectation).cast("double")
    if biased:
        expected = biased_variance(expected, F.col("localization_count"))
    return out.withColumn("expectation", expected).withColumn("ratio", F.col(f"{column}_var_mean") / F.col("expectation"))
