"""Most likely parameters of any law: damped Newton rounds, each one pass that leaves one row of sums per partition."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import check_columns
from ..functions.distributions import bessel_i0
from .components import written

#: Step of the differences that give slopes and curvatures, in units of a parameter's logarithm or of the values' deviation.
STEP = 2e-3


def log_bessel_i0(x: np.ndarray) -> np.ndarray:
    """Logarithm of the modified Bessel function of order 0, without overflow; the series for large x has an error below 1e-13."""
    x = np.abs(np.asarray(x, float))
    far, term = np.ones_like(x), np.ones_like(x)
    y = np.maximum(x, 30)
    for k in range(1, 15):
        term = term * (2 * k - 1) ** 2 / (8 * k * y)
        far = far + term
    return np.where(x <= 30, np.log(bessel_i0(np.minimum(x, 30))), x - np.log(2 * math.pi * y) / 2 + np.log(far))


@dataclass(frozen=True)
class Law:
    """A law to fit: parameter names, log density of (values, *parameters), first guess from (mean, deviation, least value), and
    which parameters are above 0. The density may be minus infinity outside of the law's range."""

    names: tuple[str, ...]
    log_density: Callable[..., np.ndarray]
    start: Callable[[float, float, float], Sequence[float]]
    positive: tuple[str, ...]


def _norm(x, loc, scale):
    return -(((x - loc) / scale) ** 2) / 2 - np.log(scale * math.sqrt(2 * math.pi))


def _above(f):
    """``f`` for values above ``loc``, minus infinity for others."""

    def density(x, *parameters):
        *shape, loc, scale = parameters
        z = (x - loc) / scale
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(z > 0, f(np.where(z > 0, z, 1.0), *shape) - np.log(scale), -np.inf)

    return density


def _expon(x, loc, scale):
    return np.where(x >= loc, -(x - loc) / scale - np.log(scale), -np.inf)


def _gamma(z, a):
    return (a - 1) * np.log(z) - z - math.lgamma(a)


def _weibull(z, c):
    return np.log(c) + (c - 1) * np.log(z) - z**c


def _lognorm(z, s):
    return -((np.log(z) / s) ** 2) / 2 - np.log(z * s * math.sqrt(2 * math.pi))


def _pairwise(dimension: int):
    """Distance between points of two normal laws of one deviation whose means are ``mu`` apart."""

    def density(x, mu, sigma):
        s2 = 2 * sigma * sigma
        z = x * mu / s2
        with np.errstate(divide="ignore"):
            if dimension == 1:
                return math.log(math.sqrt(2 / math.pi)) - np.log(s2) / 2 - (mu * mu + x * x) / (2 * s2) + np.logaddexp(z, -z) - math.log(2)
            if dimension == 2:
                return np.log(x / s2) - (mu * mu + x * x) / (2 * s2) + log_bessel_i0(z)
            return math.log(math.sqrt(2 / math.pi)) - np.log(s2) / 2 + np.log(x / mu) - (mu * mu + x * x) / (2 * s2) + z + np.log(-np.expm1(-2 * z) / 2)

    return density


def _pairwise_zero(dimension: int):
    def density(x, sigma):
        s2 = sigma * sigma
        with np.errstate(divide="ignore"):
            return (dimension - 1) * np.log(x) - x * x / (4 * s2) - dimension * np.log(sigma) - (0.5 * math.log(math.pi), math.log(2), math.log(2 * math.sqrt(math.pi)))[dimension - 1]

    return density


def _nearest(dimension: int):
    ball = (2.0, math.pi, 4 / 3 * math.pi)[dimension - 1]

    def density(x, density):
        with np.errstate(divide="ignore"):
            return np.log(dimension * ball * density) + (dimension - 1) * np.log(x) - ball * density * x**dimension

    return density


LAWS = {
    "norm": Law(("loc", "scale"), _norm, lambda m, s, lo: (m, s), ("scale",)),
    "expon": Law(("loc", "scale"), _expon, lambda m, s, lo: (lo, m - lo), ("scale",)),
    "gamma": Law(("a", "loc", "scale"), _above(_gamma), lambda m, s, lo: ((m / s) ** 2, 0.0, s * s / m), ("a", "scale")),
    "weibull_min": Law(("c", "loc", "scale"), _above(_weibull), lambda m, s, lo: (m / s, 0.0, m), ("c", "scale")),
    "lognorm": Law(("s", "loc", "scale"), _above(_lognorm), lambda m, s, lo: (math.sqrt(math.log1p((s / m) ** 2)), 0.0, m / math.sqrt(1 + (s / m) ** 2)), ("s", "scale")),
    **{f"pairwise_{d}d": Law(("mu", "sigma"), _pairwise(d), lambda m, s, lo: (m, s), ("mu", "sigma")) for d in (1, 2, 3)},
    **{f"pairwise_{d}d_zero_mu": Law(("sigma",), _pairwise_zero(d), lambda m, s, lo, d=d: (math.hypot(m, s) / math.sqrt(2 * d),), ("sigma",)) for d in (1, 2, 3)},
    **{f"nearest_{d}d": Law(("density",), _nearest(d), lambda m, s, lo, d=d: ((1 / (2 * m)) ** d,), ("density",)) for d in (1, 2, 3)},
}
#: Parameters that are not fitted unless asked for: where the laws begin.
FIXED = {"gamma": {"loc": 0.0}, "weibull_min": {"loc": 0.0}, "lognorm": {"loc": 0.0}}


def fit_law(df: DataFrame, column: str, law: str | Law, *, fixed: Mapping[str, float] | None = None, start: Mapping[str, float] | None = None, rounds: int = 100, slope: float = 1e-9) -> DataFrame:
    """(parameter, value, error, slope, log_likelihood, n, rounds): the most likely parameters of ``law``, one row each.

    ``law`` is a name of ``LAWS`` or a law of your own. ``fixed`` holds parameters at values (by default the ``loc`` of gamma, Weibull and
    lognormal laws at 0, and that of the exponential law at the least value, where it is most likely); ``start`` replaces first guesses.
    ``slope`` is the mean slope of the log density by a parameter's logarithm (or by its value over the values' deviation), ``error`` the
    standard error from the curvature (null for fixed parameters, or where the curvature is not that of a maximum).
    Rounds end when every slope is below ``slope`` or no step helps. Null, NaN and infinite values do not count; without values, results are null.
    """
    check_columns(df.columns, [column])
    name = law if isinstance(law, str) else None
    law = LAWS[law] if name else law
    unknown = (set(fixed or ()) | set(start or ())) - set(law.names)
    if unknown:
        raise ValueError(f"the law has no parameter {sorted(unknown)}")
    x = F.col(column).cast("double")
    values = written(df.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    n, mean, deviation, least = values.agg(F.count("*"), F.avg("x"), F.stddev_pop("x"), F.min("x")).first()
    schema = "parameter string, value double, error double, slope double, log_likelihood double, n long, rounds int"
    if not n:
        return df.sparkSession.createDataFrame([(p, None, None, None, None, 0, 0) for p in law.names], schema)
    unit = deviation or abs(mean) or 1.0
    held = {**FIXED.get(name, {}), **({"loc": least} if name == "expon" else {}), **(fixed or {})}
    guess = dict(zip(law.names, law.start(mean, unit, least))) | dict(start or {}) | held
    free = [p for p in law.names if p not in held]
    if any(guess[p] <= 0 for p in law.names if p in law.positive):
        raise ValueError("first guesses of these parameters have to be above 0: " + ", ".join(law.positive))
    inner = np.array([math.log(guess[p]) if p in law.positive else guess[p] / unit for p in free])

    def outer(t: Sequence[float]) -> list[float]:
        own = {p: math.exp(v) if p in law.positive else v * unit for p, v in zip(free, t)}
        return [own.get(p, held.get(p)) for p in law.names]

    def sums(t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean log density, its slopes and curvatures."""
        total = values.mapInArrow(_sums_of(law.log_density, outer, t.copy()), "s array<double>").select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()  # one row per sum
        s = np.zeros(1 + len(t) + len(t) ** 2)
        for k, v in total:
            s[k] = v
        return s[0] / n, s[1 : 1 + len(t)] / n, s[1 + len(t) :].reshape(len(t), len(t)) / n

    level, slopes, curve = sums(inner)
    if not math.isfinite(level):
        raise ValueError("a value has no density at the first guess; give another start")
    damp, done = 1e-3, 0
    while free and done < rounds and np.abs(slopes).max() > slope:
        done += 1
        down = -(curve + curve.T) / 2
        w, axes = np.linalg.eigh(down)
        w = np.maximum(np.abs(w), 1e-12)  # uphill even where the surface is not curved like a maximum
        step = axes @ ((axes.T @ slopes) / (w + damp * w.max()))
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        new = sums(inner + step)
        flat = np.abs(step).max() < 1e-13
        if math.isfinite(new[0]) and (new[0] >= level or abs(new[0] - level) < 1e-13 * (1 + abs(level)) and np.abs(new[1]).max() < np.abs(slopes).max()):
            inner, (level, slopes, curve), damp = inner + step, new, damp / 10
        else:
            damp = max(damp, 1e-9) * 10
        if flat or damp > 1e12:
            break
    error = {}
    if free and np.linalg.eigvalsh(-(curve + curve.T) / 2).min() > 0:
        spread = np.sqrt(np.diag(np.linalg.inv(-(curve + curve.T) / 2)) / n)
        found = dict(zip(law.names, outer(inner)))
        error = {p: float(e * (found[p] if p in law.positive else unit)) for p, e in zip(free, spread)}
    by_slope = dict(zip(free, slopes.tolist()))
    return df.sparkSession.createDataFrame([(p, float(v), error.get(p), by_slope.get(p), float(level * n), n, done) for p, v in zip(law.names, outer(inner))], schema)


def _sums_of(log_density: Callable, outer: Callable, t: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    m = len(t)
    at = lambda *moves: outer(t + sum((np.eye(m)[i] * k * STEP for i, k in moves), np.zeros(m)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + m + m * m)
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            f = lambda *moves: log_density(x, *at(*moves))
            with np.errstate(invalid="ignore"):
                here = f()
                own = [here.sum()]
                along = [[f((i, k)) for k in (-2, -1, 1, 2)] for i in range(m)]
                own += [((a[0] - a[3]) + 8 * (a[2] - a[1])).sum() / (12 * STEP) for a in along]
                for i in range(m):
                    for j in range(m):
                        if i == j:
                            a = along[i]
                            own.append((16 * (a[1] + a[2]) - (a[0] + a[3]) - 30 * here).sum() / (12 * STEP**2))
                        elif i < j:
                            own.append((f((i, 1), (j, 1)) - f((i, 1), (j, -1)) - f((i, -1), (j, 1)) + f((i, -1), (j, -1))).sum() / (4 * STEP**2))
                        else:
                            own.append(own[1 + m + j * m + i])
            total += np.array(own)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    return run
