"""Closed forms as Column functions: GEV and GPD, copulas, gamma; all run inside generated code.

Shapes follow the hydrological sign: xi > 0 is heavy-tailed. Below 1e-6 in size a shape counts as zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-6
# fixed values: Lanczos coefficients, g = 7
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def gamma(x) -> Column:
    """Gamma function of x > 0.5 by the Lanczos series."""
    z = _c(x) - 1
    s = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        s = s + F.lit(c) / (z + k)
    t = z + 7.5
    return F.lit((2 * 3.141592653589793) ** 0.5) * F.pow(t, z + 0.5) * F.exp(-t) * s


def gev_quantile(p, mu, sigma, xi) -> Column:
    p, mu, sigma, xi = map(_c, (p, mu, sigma, xi))
    y = -F.log(p)
    return F.when(F.abs(xi) < TINY, mu - sigma * F.log(y)).otherwise(mu + sigma / xi * (F.pow(y, -xi) - 1))


def gev_level(t, mu, sigma, xi) -> Column:
    """The level exceeded once in t blocks on average."""
    return gev_quantile(1 - 1 / _c(t), mu, sigma, xi)


def gev_cdf(x, mu, sigma, xi) -> Column:
    """Outside the support 0 or 1."""
    x, mu, sigma, xi = map(_c, (x, mu, sigma, xi))
    z = (x - mu) / sigma
    w = 1 + xi * z
    inner = F.when(w > 0, F.exp(-F.pow(F.greatest(w, F.lit(1e-300)), -1 / F.when(F.abs(xi) < TINY, F.lit(1.0)).otherwise(xi)))).when(xi > 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(F.abs(xi) < TINY, F.exp(-F.exp(-z))).otherwise(inner)


def gev_period(x, mu, sigma, xi) -> Column:
    """Blocks between exceedances of x on average: infinite where none is left, NaN outside the support."""
    x, mu, sigma, xi = map(_c, (x, mu, sigma, xi))
    w = 1 + xi * ((x - mu) / sigma)
    above = 1 - gev_cdf(x, mu, sigma, xi)
    inside = F.when(above == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), above))
    return F.when((F.abs(xi) >= TINY) & (w < 0), F.lit(float("nan"))).when(w.isNotNull(), inside)


def gpd_level(t, scale, shape, threshold, rate) -> Column:
    t, scale, shape, threshold, rate = map(_c, (t, scale, shape, threshold, rate))
    return F.when(F.abs(shape) < TINY, threshold + scale * F.log(rate * t)).otherwise(threshold + scale / shape * (F.pow(rate * t, shape) - 1))


def copula_cdf(family: str, theta, *u) -> Column:
    """C(u, ...) of the Gumbel, Clayton or Frank family in two or three dimensions."""
    th, us = _c(theta), [F.greatest(F.lit(1e-10), F.least(_c(x), F.lit(1 - 1e-10))) for x in u]
    if family == "gumbel":
        s = sum((F.pow(-F.log(x), th) for x in us), F.lit(0.0))
        return F.exp(-F.pow(s, 1 / th))
    if family == "clayton":
        s = sum((F.pow(x, -th) for x in us), F.lit(0.0)) - (len(us) - 1)
        return F.pow(F.greatest(s, F.lit(0.0)), -1 / th)
    if family == "frank":
        top = F.lit(1.0)
        for x in us:
            top = top * (F.exp(-th * x) - 1)
        flat = F.lit(1.0)
        for x in us:
            flat = flat * x
        return F.when(F.abs(th) < 1e-8, flat).otherwise(-1 / th * F.log(1 + top / F.pow(F.exp(-th) - 1, F.lit(float(len(us) - 1)))))
    raise ValueError(f"unknown family {family!r}")


def tail_dependence(family: str, theta) -> tuple[Column, Column]:
    """(lower, upper) coefficients."""
    th = _c(theta)
    if family == "gumbel":
        return F.lit(0.0), F.when(th > 1, 2 - F.pow(F.lit(2.0), 1 / th)).otherwise(0.0)
    if family == "clayton":
        return F.when(th > 0, F.pow(F.lit(2.0), -1 / th)).otherwise(0.0), F.lit(0.0)
    return F.lit(0.0), F.lit(0.0)
