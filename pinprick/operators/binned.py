"""Binned aggregates: histograms, grid clusters, images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import check_columns
from ..functions.binning import Bins


def histogram(df: DataFrame, bins: Bins, columns: Sequence[str] | None = None, value: str | None = None, *, by: Sequence[str] = (), dense: bool = False) -> DataFrame:
    """Rows (b0, b1, ..., count) or, with ``value``, its mean per bin; out of range rows are dropped.

    ``dense`` adds the empty bins (count 0, mean null), as many as the specification has.
    """
    columns = check_columns(df.columns, columns)[: bins.dimension]
    names = [f"b{k}" for k in range(bins.dimension)]
    rows = df.withColumns({n: bins.index(k, F.col(c)) for k, (n, c) in enumerate(zip(names, columns))}).dropna(subset=names)
    out = rows.groupBy(*by, *names).agg(F.avg(value).alias("mean") if value else F.count("*").alias("count"))
    if dense:
        grid = image_from_bins(df.sparkSession, bins, None)
        out = grid.join(out, names, "left")
        if not value:
            out = out.withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    return out


def image_from_bins(spark, bins: Bins, value: float | None = 1) -> DataFrame:
    """All bins of the specification, with a constant value."""
    out = spark.range(1).select()
    for k, n in enumerate(bins.n_bins):
        out = out.withColumn(f"b{k}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out if value is None else out.withColumn("value", F.lit(float(value)))


def cluster_by_bin(df: DataFrame, bins: Bins, columns: Sequence[str] | None = None, min_samples: int = 1) -> DataFrame:
    """Rows of every bin with at least ``min_samples`` rows; bins count from 1, with 0 and n + 1 for what lies
    outside, and make clusters too. Adds b0, b1, ... and ``cluster_count``."""
    columns = check_columns(df.columns, columns)[: bins.dimension]
    names = [f"b{k}" for k in range(bins.dimension)]
    rows = df.withColumns({n: bins.digitized(k, F.col(c)) for k, (n, c) in enumerate(zip(names, columns))}).dropna(subset=names)
    # counts are few rows: the join to them is broadcast by size, or else dealt by bin
    counts = rows.groupBy(*names).agg(F.count("*").alias("cluster_count")).where(F.col("cluster_count") >= min_samples)
    return rows.join(counts, names)


def adjust_contrast(image: DataFrame, value: str = "value", lower: float = 0.0, upper: float = 1.0) -> DataFrame:
    """Image values rescaled linearly from their range to [lower, upper]."""
    r = image.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return image.crossJoin(F.broadcast(r)).withColumn(value, lower + (F.col(value) - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0) * (upper - lower)).drop("_lo", "_hi")  # one row is broadcast


def equalize_histogram(image: DataFrame, value: str = "value", *, power: float = 1, n_bins: int = 65536) -> DataFrame:
    """Image values replaced by their place in the cumulative histogram of counts to the given power."""
    from pyspark.sql import Window

    r = image.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = image.crossJoin(F.broadcast(r)).withColumn("_b", F.least(F.floor((F.col(value) - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0) * n_bins), F.lit(n_bins - 1)))
    counts = at.groupBy("_b").agg(F.pow(F.count("*"), F.lit(power)).alias("_c"))  # at most n_bins rows
    cdf = counts.select("_b", (F.sum("_c").over(Window.orderBy("_b")) / F.sum("_c").over(Window.partitionBy(F.lit(1)))).alias("_f"))
    return at.join(F.broadcast(cdf), "_b").withColumn(value, F.col("_f")).drop("_b", "_f", "_lo", "_hi")


def transform_intensity(image: DataFrame, trafo: str = "standardize", value: str = "value") -> DataFrame:
    """Image values by a named rule: none; standardize (the range to 0..1); zero (0 and the maximum to 0..1);
    equalize (by the values above 0), equalize_all (by all), equalize_0p3 and equalize_0p3_all (counts to the power 0.3);
    with ``_uint8`` at the end, whole numbers from 0 to 255."""
    name = trafo.removesuffix("_uint8")
    if name == "none":
        out = image
    elif name == "standardize":
        out = adjust_contrast(image, value)
    elif name == "zero":
        top = image.agg(F.max(value).alias("_hi"))
        out = image.crossJoin(F.broadcast(top)).withColumn(value, F.col(value) / F.when(F.col("_hi") != 0, F.col("_hi")).otherwise(1.0)).drop("_hi")  # one row is broadcast
    elif name.startswith("equalize"):
        power = 0.3 if "0p3" in name else 1
        if name.endswith("_all"):
            out = equalize_histogram(image, value, power=power)
        else:
            zero = image.where(F.col(value) <= 0).withColumn(value, F.lit(0.0))
            out = equalize_histogram(image.where(F.col(value) > 0), value, power=power).unionByName(zero)
    else:
        raise ValueError(f"no rule {trafo}")
    return out.withColumn(value, F.floor(F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0)) * 255).cast("int")) if trafo.endswith("_uint8") else out


def apply_window(image: DataFrame, bins: Bins, value: str = "value", alpha: float = 0.5) -> DataFrame:
    """Image values tapered along each axis by a cosine over the outer ``alpha`` share."""
    import math

    out = F.col(value)
    for k, n in enumerate(bins.n_bins):
        at = F.col(f"b{k}") / max(n - 1, 1)
        edge = F.least(at, 1 - at)
        out = out * F.when(edge < alpha / 2, (1 - F.cos(2 * math.pi * edge / alpha)) / 2).otherwise(1.0)
    return image.withColumn(value, out)


def localization_property_2d(df: DataFrame, bins: Bins, value: str, columns: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Mean image of a property and the Gaussian surface that fits its bins (as many numbers as bins reach the driver)."""
    import numpy as np

    from ..functions.distributions import fit_gauss_2d

    image = histogram(df, bins, columns, value)
    rows = image.dropna().toPandas()
    x, y = (np.array(c) for c in bins.bin_centers)
    return image, fit_gauss_2d(x[rows.b0], y[rows.b1], rows["mean"].to_numpy(float))


def render_rgb(df: DataFrame, bins: Bins, channel: str = "channel", columns: Sequence[str] | None = None) -> DataFrame:
    """Counts per channel and bin: one binned image per channel."""
    return histogram(df, bins, columns, by=[channel])
