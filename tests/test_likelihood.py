"""Likelihood fits: known parameters come back, slopes vanish, and no neighbouring parameters are likelier."""

import math

import numpy as np
import pytest

from pinprick.functions import distributions
from pinprick.operators.likelihood import LAWS, Law, fit_law, log_bessel_i0

N = 20_000


def frame_of(spark, x):
    return spark.createDataFrame([(float(v), "x") for v in x], "value double, law string").repartition(3)


def drawn(name):
    r = np.random.default_rng(11)
    d = int(name[-2]) if name[-1] == "d" else int(name.split("_")[1][0]) if "pairwise" in name else 0
    if name.endswith("zero_mu"):
        return np.linalg.norm(r.normal(0, 0.3, (N, d)) - r.normal(0, 0.3, (N, d)), axis=1), {"sigma": 0.3}
    if name.startswith("pairwise"):
        apart = np.array([1.5, 0, 0][:d])
        return np.linalg.norm(r.normal(0, 0.5, (N, d)) + apart - r.normal(0, 0.5, (N, d)), axis=1), {"mu": 1.5, "sigma": 0.5}
    if name.startswith("nearest"):
        ball = (2.0, math.pi, 4 / 3 * math.pi)[d - 1]
        return (r.exponential(1, N) / (ball * 5)) ** (1 / d), {"density": 5}
    return {
        "norm": (r.normal(40, 3, N), {"loc": 40, "scale": 3}),
        "expon": (7 + r.exponential(2, N), {"loc": 7, "scale": 2}),
        "gamma": (r.gamma(2.5, 30, N), {"a": 2.5, "scale": 30, "loc": 0}),
        "weibull_min": (4 * r.weibull(1.7, N), {"c": 1.7, "scale": 4, "loc": 0}),
        "lognorm": (np.exp(r.normal(2, 0.4, N)), {"s": 0.4, "scale": math.exp(2), "loc": 0}),
    }[name]


@pytest.mark.parametrize("name", sorted(LAWS))
def test_known_parameters_come_back(spark, name):
    x, want = drawn(name)
    got = {r.parameter: r for r in fit_law(frame_of(spark, x), "value", name).collect()}
    assert set(got) == set(LAWS[name].names) == set(want)
    best = {p: got[p].value for p in LAWS[name].names}
    level = lambda v: float(LAWS[name].log_density(x, *(v[p] for p in LAWS[name].names)).sum())
    assert got[LAWS[name].names[0]].log_likelihood == pytest.approx(level(best))
    for p, r in got.items():
        assert r.n == N and r.value == pytest.approx(want[p], rel=0.04, abs=1e-3)
        if r.slope is None:
            assert r.error is None and p == "loc"
            continue
        assert abs(r.slope) < 1e-6 and abs(r.value - want[p]) < 5 * r.error
        for f in (0.998, 1.002):
            assert level(best | {p: r.value * f}) < level(best)


def test_densities_are_the_library_s():
    x = np.linspace(0.1, 4, 50)
    assert np.allclose(np.exp(LAWS["pairwise_2d"].log_density(x, 1.2, 0.5)), distributions.pdf_pairwise_2d(x, 1.2, 0.5, 0.5))
    fine = np.linspace(1e-6, 40, 400_001)
    for name in LAWS:
        if name.startswith(("pairwise", "nearest")):
            p = {"mu": 1.2, "sigma": 0.5, "density": 0.8}
            y = np.exp(LAWS[name].log_density(fine, *(p[k] for k in LAWS[name].names)))
            assert ((y[1:] + y[:-1]) / 2 * np.diff(fine)).sum() == pytest.approx(1, abs=1e-5), name
    big = np.array([29.999, 30.001, 500.0, 1e5])
    assert np.allclose(np.diff(log_bessel_i0(big[:2])), 0.002 * (1 - 1 / 60), rtol=1e-3) and np.isfinite(log_bessel_i0(big)).all()
    assert log_bessel_i0(np.array([1.0]))[0] == pytest.approx(math.log(1.2660658777520084), rel=1e-12)


def test_closed_forms(spark):
    x, _ = drawn("norm")
    got = {r.parameter: r for r in fit_law(frame_of(spark, x), "value", "norm").collect()}
    assert got["loc"].value == pytest.approx(x.mean(), rel=1e-9) and got["scale"].value == pytest.approx(x.std(), rel=1e-9)
    assert got["loc"].error == pytest.approx(x.std() / math.sqrt(N), rel=1e-4)
    held = {r.parameter: r for r in fit_law(frame_of(spark, x), "value", "norm", fixed={"loc": 39}).collect()}
    assert held["loc"].value == 39 and held["scale"].value == pytest.approx(math.sqrt(((x - 39) ** 2).mean()), rel=1e-9)


def test_a_law_of_ones_own_and_odd_rows(spark):
    x = np.random.default_rng(4).laplace(3, 2, 5000)
    smooth = Law(("at", "width"), lambda v, at, width: -np.sqrt(1 + ((v - at) / width) ** 2) - np.log(width), lambda m, s, lo: (m, s), ("width",))
    df = frame_of(spark, [*x, math.nan, math.inf]).unionByName(spark.createDataFrame([(None, None)], "value double, law string"))
    got = {r.parameter: r for r in fit_law(df, "value", smooth).collect()}
    assert got["at"].n == 5000 and abs(got["at"].value - 3) < 0.2 and abs(got["width"].slope) < 1e-6
    none = fit_law(df.where("false"), "value", "gamma").collect()
    assert [(r.parameter, r.value, r.n) for r in none] == [("a", None, 0), ("loc", None, 0), ("scale", None, 0)]
    with pytest.raises(ValueError):
        fit_law(df, "value", "norm", fixed={"a": 1})
    with pytest.raises(ValueError):  # values below the law's beginning
        fit_law(df, "value", "gamma").collect()
    one = {r.parameter: r for r in fit_law(frame_of(spark, [2.0]), "value", "pairwise_2d_zero_mu").collect()}
    assert one["sigma"].value == pytest.approx(1.0, rel=1e-6)
