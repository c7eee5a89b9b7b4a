"""Closed-form fits by aggregates, and distribution functions as expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_expon(df: DataFrame, column: str) -> DataFrame:
    """Exponential law: location (minimum) and scale (mean less location)."""
    return df.agg(F.min(column).cast("double").alias("loc"), (F.avg(column) - F.min(column)).alias("scale"))


def fit_norm(df: DataFrame, column: str) -> DataFrame:
    """Normal law: mean and deviation (dividing by n)."""
    return df.agg(F.avg(column).alias("loc"), F.stddev_pop(column).alias("scale"))


def fit_pairwise_sigma(df: DataFrame, column: str = "position_distance", dimension: int = 2) -> DataFrame:
    """Sigma of distances between two points of one normal law: root of the mean square over the dimension."""
    return df.agg(F.sqrt(F.avg(F.col(column) * F.col(column)) / dimension).alias("sigma"))


def pdf_nn_csr_2d(x: Column, density: float) -> Column:
    return 2 * density * math.pi * x * F.exp(-density * math.pi * x * x)


def pdf_nn_csr_3d(x: Column, density: float) -> Column:
    a = 4 / 3 * math.pi * density
    return 3 * a * x * x * F.exp(-a * x * x * x)


def bessel_i0(x: np.ndarray) -> np.ndarray:
    """Modified Bessel function of order 0, by its power series where small and scaled asymptotics where large."""
    x = np.abs(np.asarray(x, float))
    out, term = np.ones_like(x), np.ones_like(x)
    small = np.minimum(x, 30)
    for k in range(1, 80):
        term = term * (small / (2 * k)) ** 2
        out = out + term
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        far = np.exp(x) / np.sqrt(2 * math.pi * x) * (1 + 1 / (8 * x) + 9 / (128 * x * x) + 225 / (3072 * x**3))
    return np.where(x <= 30, out, far)


def pdf_pairwise_1d(x: Column, mu: float, sigma_1: float, sigma_2: float) -> Column:
    """Distance between points of two 1-D normal laws whose means are ``mu`` apart."""
    s2 = sigma_1**2 + sigma_2**2
    return math.sqrt(2 / math.pi) / math.sqrt(s2) * F.exp(-(mu * mu + x * x) / (2 * s2)) * F.cosh(x * mu / s2)


def pdf_pairwise_2d(x, mu: float, sigma_1: float, sigma_2: float) -> np.ndarray:
    s2, x = sigma_1**2 + sigma_2**2, np.asarray(x, float)
    return x / s2 * np.exp(-(mu * mu + x * x) / (2 * s2)) * bessel_i0(x * mu / s2)


def pdf_pairwise_3d(x: Column, mu: float, sigma_1: float, sigma_2: float) -> Column:
    s2 = sigma_1**2 + sigma_2**2
    return math.sqrt(2 / math.pi) / math.sqrt(s2) * x / mu * F.exp(-(mu * mu + x * x) / (2 * s2)) * F.sinh(x * mu / s2)


def pdf_pairwise_zero_mu(x: Column, sigma: float, dimension: int) -> Column:
    """Distance between two points of one normal law with deviation ``sigma``; their difference has twice the variance."""
    s2 = sigma * sigma
    if dimension == 1:
        return 1 / (math.sqrt(math.pi) * sigma) * F.exp(-x * x / (4 * s2))
    if dimension == 2:
        return x / (2 * s2) * F.exp(-x * x / (4 * s2))
    return x * x / (2 * math.sqrt(math.pi) * s2 * sigma) * F.exp(-x * x / (4 * s2))


def gauss_2d(x: Column, y: Column, amplitude: float, center_x: float, center_y: float, sigma_x: float, sigma_y: float) -> Column:
    return amplitude * F.exp(-(((x - center_x) / sigma_x) * ((x - center_x) / sigma_x) + ((y - center_y) / sigma_y) * ((y - center_y) / sigma_y)) / 2)


def fit_gauss_2d(x: np.ndarray, y: np.ndarray, z: np.ndarray, rounds: int = 100) -> dict[str, float]:
    """Least-squares Gaussian surface through (x, y, z), by damped Gauss-Newton steps; for binned images."""
    ok = np.isfinite(z)
    x, y, z = x[ok], y[ok], z[ok]
    w = np.clip(z, 0, None)
    total = w.sum() or 1.0
    cx, cy = (w * x).sum() / total, (w * y).sum() / total
    p = np.array([z.max(), cx, cy, max(np.sqrt((w * (x - cx) ** 2).sum() / total), 1e-9), max(np.sqrt((w * (y - cy) ** 2).sum() / total), 1e-9)])
    value = lambda q: q[0] * np.exp(-(((x - q[1]) / q[3]) ** 2 + ((y - q[2]) / q[4]) ** 2) / 2)
    damp, error = 1e-3, ((value(p) - z) ** 2).sum()
    for _ in range(rounds):
        f = value(p)
        j = np.stack([f / (p[0] or 1e-12), f * (x - p[1]) / p[3] ** 2, f * (y - p[2]) / p[4] ** 2, f * (x - p[1]) ** 2 / p[3] ** 3, f * (y - p[2]) ** 2 / p[4] ** 3], 1)
        a = j.T @ j
        new = p + np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), j.T @ (z - f))
        e = ((value(new) - z) ** 2).sum()
        if e < error:
            done = error - e < 1e-14 * max(error, 1e-300)
            p, error, damp = new, e, damp / 3
            if done:
                break
        else:
            damp *= 4
    return dict(zip(("amplitude", "center_x", "center_y", "sigma_x", "sigma_y"), [p[0], p[1], p[2], abs(p[3]), abs(p[4])]))
