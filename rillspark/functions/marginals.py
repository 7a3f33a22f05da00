"""Fitted univariate distributions in numpy, of parameters (a, b, c): distribution function, quantile and density.

gev has location, scale and shape; gumbel and normal location and scale; lognormal the mean and deviation of logarithms;
gamma and weibull shape and scale; exponential its scale. Parameters that a family does not have are zero."""

from __future__ import annotations

import numpy as np

from . import special

TINY = 1e-6
#: Families whose support begins at zero; their location is held there.
POSITIVE = ("lognormal", "gamma", "exponential", "weibull")


def cdf(family: str, x: np.ndarray, a: float, b: float, c: float = 0.0) -> np.ndarray:
    x = np.asarray(x, float)
    if family in ("gev", "gumbel"):
        z = (x - a) / b
        if family == "gumbel" or abs(c) < TINY:
            return np.exp(-np.exp(-z))
        w = 1 + c * z
        return np.where(w > 0, np.exp(-np.maximum(w, 1e-300) ** (-1 / c)), 0.0 if c > 0 else 1.0)
    if family == "normal":
        return special.normal_cdf((x - a) / b)
    at = np.maximum(x, 1e-300)
    if family == "lognormal":
        p = special.normal_cdf((np.log(at) - a) / b)
    elif family == "gamma":
        p = special.gamma_cdf(at / b, a)
    elif family == "exponential":
        p = -np.expm1(-at / a)
    elif family == "weibull":
        p = -np.expm1(-((at / b) ** a))
    else:
        raise ValueError(f"unknown family {family!r}")
    return np.where(x > 0, p, 0.0)


def quantile(family: str, p: np.ndarray, a: float, b: float, c: float = 0.0) -> np.ndarray:
    p = np.asarray(p, float)
    if family in ("gev", "gumbel"):
        y = -np.log(p)
        return a - b * np.log(y) if family == "gumbel" or abs(c) < TINY else a + b / c * (y**-c - 1)
    if family == "normal":
        return a + b * special.normal_ppf(p)
    if family == "lognormal":
        return np.exp(a + b * special.normal_ppf(p))
    if family == "gamma":
        return b * special.gamma_ppf(p, a)
    if family == "exponential":
        return -a * np.log1p(-p)
    if family == "weibull":
        return b * (-np.log1p(-p)) ** (1 / a)
    raise ValueError(f"unknown family {family!r}")


def density(family: str, x: np.ndarray, a: float, b: float, c: float = 0.0) -> np.ndarray:
    """By central differences of the distribution function, with steps in proportion to the spread."""
    h = 1e-5 * max(abs(float(quantile(family, 0.75, a, b, c) - quantile(family, 0.25, a, b, c))), 1e-12)
    return np.maximum(cdf(family, x + h, a, b, c) - cdf(family, x - h, a, b, c), 0.0) / (2 * h)
