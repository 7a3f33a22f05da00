"""Joint distributions: marginals, level curves, design events; neighbourhoods of kriging and Gaussian processes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.functions import distributions as dist
from rillspark.functions import marginals as mg
from rillspark.operators import fields, joint

CASES = [("gev", 10.0, 2.0, 0.1), ("gev", 10.0, 2.0, -0.2), ("gumbel", 5.0, 2.0, 0.0), ("normal", 1.0, 3.0, 0.0), ("lognormal", 0.5, 0.4, 0.0), ("gamma", 2.5, 3.0, 0.0), ("exponential", 4.0, 0.0, 0.0), ("weibull", 1.7, 2.0, 0.0)]


@pytest.mark.parametrize("family,a,b,c", CASES)
def test_marginal_round_trip(family, a, b, c):
    p = np.array([0.01, 0.3, 0.5, 0.9, 0.999])
    x = mg.quantile(family, p, a, b, c)
    assert mg.cdf(family, x, a, b, c) == pytest.approx(p, abs=1e-7)
    grid = mg.quantile(family, np.linspace(0.001, 0.999, 4000), a, b, c)
    assert np.trapezoid(mg.density(family, grid, a, b, c), grid) == pytest.approx(0.998, abs=5e-3)


def test_fit_and_transform(spark):
    g = np.random.default_rng(3)
    x = np.exp(1 + 0.5 * g.standard_normal(3000))
    y = g.normal(-5, 2, 3000)
    d = spark.createDataFrame([("s", float(i), float(j)) for i, j in zip(x, y)] + [("t", 1.0, None)], "series_id string, x double, y double")
    m = joint.fit_marginals(d, ["x", "y"], ("lognormal", "gamma", "normal"))
    got = {r.variable: r for r in m.collect()}
    assert set(got) == {"x", "y"} and got["x"].family == "lognormal" and got["y"].family == "normal" and got["x"].n == 3000
    assert (got["x"].a, got["x"].b) == pytest.approx((1, 0.5), abs=0.03)
    u = joint.through_marginal(d.where("series_id = 's'").join(m.where("variable = 'x'"), "series_id"), "x", "u")
    back = joint.through_marginal(u, "u", "again", "quantile").agg(F.max(F.abs(F.col("again") - F.col("x"))), F.avg("u")).first()
    assert back[0] < 1e-3 and back[1] == pytest.approx(0.5, abs=0.01)
    with pytest.raises(ValueError):
        joint.fit_marginals(d, ["x"], ("cauchy",))
    with pytest.raises(ValueError):
        joint.through_marginal(u, "u", "v", "median")


@pytest.mark.parametrize("family", ["gumbel", "clayton", "frank"])
@pytest.mark.parametrize("scenario", ["or", "and"])
def test_contour(spark, family, scenario):
    th = spark.createDataFrame([("a", 1.5), ("b", 4.0)], "k string, theta double")
    c = joint.contour(th, family, 20.0, scenario, 30)
    cdf = dist.copula_cdf(family, "theta", "u", "v")
    p = 1 - cdf if scenario == "or" else 1 - F.col("u") - F.col("v") + cdf
    rows = c.select("k", "i", "u", "v", p.alias("p")).collect()
    assert {r.k for r in rows} == {"a", "b"} and len(rows) > 50
    assert all(r.p == pytest.approx(0.05, abs=1e-8) for r in rows)
    with pytest.raises(ValueError):
        joint.contour(th, family, 20.0, "xor")


@pytest.mark.parametrize("family,theta", [("gumbel", 2.0), ("clayton", 1.5), ("frank", 4.0), ("frank", -3.0)])
def test_density_is_the_mixed_derivative(spark, family, theta):
    e = 1e-4
    d = spark.createDataFrame([(0.2, 0.3), (0.5, 0.5), (0.9, 0.6)], "u double, v double")
    c = lambda a, b: dist.copula_cdf(family, theta, F.col("u") + a, F.col("v") + b)
    rows = d.select(joint.copula_density(family, theta, "u", "v").alias("c"), ((c(e, e) - c(e, -e) - c(-e, e) + c(-e, -e)) / (4 * e * e)).alias("w")).collect()
    assert all(r.c == pytest.approx(r.w, rel=1e-3) for r in rows)


def test_most_probable_event(spark):
    th = spark.createDataFrame([("a", 2.0)], "k string, theta double")
    one = spark.createDataFrame([("a", "normal", 0.0, 1.0, 0.0)], "k string, family string, a double, b double, c double")
    curve = joint.curve_in_units(joint.contour(th, "frank", 20.0, "and", 201), one, one, "k")
    r = joint.most_probable(curve, "frank", "k").first()
    best = max(curve.select("x", "y", (joint.copula_density("frank", "theta", "u", "v") * F.col("fxfy")).alias("f")).collect(), key=lambda q: q.f)
    assert (r.x, r.y) == (best.x, best.y)


def test_ensemble_widens(spark):
    g = np.random.default_rng(1)
    pool = spark.createDataFrame([(float(a), float(b)) for a, b in g.uniform(size=(400, 2))], "u double, v double")
    few = joint.design_ensemble(pool, "clayton", 1.0, "u", "v", 10.0, 5).collect()
    many = joint.design_ensemble(pool, "clayton", 1.0, "u", "v", 10.0, 300).collect()
    assert len(few) == 5 and len(many) == 300
    assert [r.density for r in few] == sorted((r.density for r in few), reverse=True)


def test_discrete_marginal(spark):
    d = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3), ("a", None)], "g string, v int")
    assert [(r.value, round(r.p, 4), r.cumulative) for r in joint.discrete_marginal(d, "v", "g").orderBy("value").collect()] == [(1, 0.6667, pytest.approx(2 / 3)), (3, 0.3333, 1.0)]


def test_neighbourhoods(spark):
    st = [(i, float(x), float(y), float(x + 2 * y)) for i, (x, y) in enumerate((a * 10, b * 10) for a in range(6) for b in range(6))]
    stations = spark.createDataFrame([*st, st[0]], "station long, x double, y double, value double")
    cells = spark.createDataFrame([(0, 25.0, 25.0), (1, 20.0, 30.0)], "cell long, x double, y double")
    whole = {r.cell: r for r in fields.gaussian_process(cells, stations).collect()}
    local = {r.cell: r for r in fields.gaussian_process(cells, stations, most=20, neighbours=36).collect()}
    assert all(local[k].mean == pytest.approx(whole[k].mean, rel=1e-9) and local[k].std == pytest.approx(whole[k].std, rel=1e-6) for k in whole)
    k = {r.cell: r for r in fields.kriging(cells, stations, most=30, neighbours=16).collect()}
    assert k[0].value == pytest.approx(75, abs=4) and k[1].value == pytest.approx(80, abs=1e-3)
