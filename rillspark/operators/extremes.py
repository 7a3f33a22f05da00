"""Extreme values: block maxima, plotting positions, L-moment fits, return levels, maximum likelihood."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as dist

_BLOCKS = {"year": 12, "quarter": 3, "month": 1}


def block_maxima(df: DataFrame, block: str = "year") -> DataFrame:
    """(series_id, block_end, value): the maximum of each calendar block with values, labelled by its last day."""
    if block not in _BLOCKS:
        raise ValueError(f"block must be one of {sorted(_BLOCKS)}")
    end = F.last_day(F.add_months(F.trunc(F.col("ts").cast("date"), block), _BLOCKS[block] - 1))
    return df.where("value IS NOT NULL AND NOT isnan(value)").groupBy("series_id", end.alias("block_end")).agg(F.max("value").alias("value"))


def date_of_maximum(df: DataFrame) -> DataFrame:
    """(series_id, year, ts, value): the first day of each year's maximum."""
    return df.groupBy("series_id", F.year("ts").alias("year")).agg(F.expr("min_by(ts, struct(-value, ts))").alias("ts"), F.max("value").alias("value"))


def plotting_positions(df: DataFrame, group: str = "series_id") -> DataFrame:
    """Ascending ranks with Gringorten probability and return period, and the positions for Q-Q and P-P plots."""
    w = Window.partitionBy(group).orderBy("value", "block_end")
    i, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(group))
    p = (i - 0.44) / (n + 0.12)
    return df.select(group, "block_end", "value", i.cast("long").alias("rank"), p.alias("p"), (1 / (1 - p)).alias("return_period"), ((i - 0.5) / n).alias("qq"), (i / (n + 1)).alias("pp"))


def lmoments(df: DataFrame, group: str, value: str = "value") -> DataFrame:
    """(group, n, l1, l2, t, t3, t4) from unbiased probability-weighted moments; one shuffle."""
    w = Window.partitionBy(group).orderBy(value)
    j, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(group))
    r = df.where(F.col(value).isNotNull()).select(group, F.col(value).alias("v"), j.cast("double").alias("j"), n.cast("double").alias("n"))
    b1, b2, b3 = ("j / nullif(n - 1, 0)", "j * (j - 1) / nullif((n - 1) * (n - 2), 0)", "j * (j - 1) * (j - 2) / nullif((n - 1) * (n - 2) * (n - 3), 0)")
    m = r.groupBy(group).agg(F.count("*").alias("n"), F.avg("v").alias("b0"), *(F.expr(f"avg({b} * v)").alias(f"b{k}") for k, b in enumerate((b1, b2, b3), 1)))
    m = m.selectExpr(f"`{group}`", "n", "b0 AS l1", "2 * b1 - b0 AS l2", "6 * b2 - 6 * b1 + b0 AS l3", "20 * b3 - 30 * b2 + 12 * b1 - b0 AS l4")
    return m.selectExpr(f"`{group}`", "n", "l1", "l2", "try_divide(l2, l1) AS t", "try_divide(l3, l2) AS t3", "try_divide(l4, l2) AS t4")


def gumbel_from_lmoments(m: DataFrame) -> DataFrame:
    sigma = F.col("l2") / F.log(F.lit(2.0))
    return m.select("*", (F.col("l1") - 0.5772156649015329 * sigma).alias("mu"), sigma.alias("sigma"), F.lit(0.0).alias("xi"))


def gev_from_lmoments(m: DataFrame) -> DataFrame:
    """mu, sigma, xi by the published rational approximation of the shape from the L-skewness."""
    c = 2 / (3 + F.col("t3")) - F.lit(np.log(2) / np.log(3))
    k = 7.859 * c + 2.9554 * c * c
    m = m.withColumn("k", F.when(F.abs(k) < 1e-6, F.lit(1e-6)).otherwise(k)).withColumn("g", dist.gamma(1 + F.col("k")))
    sigma = F.col("l2") * F.col("k") / ((1 - F.pow(F.lit(2.0), -F.col("k"))) * F.col("g"))
    m = m.withColumn("sigma", sigma)
    return m.withColumn("mu", F.col("l1") - F.col("sigma") * (1 - F.col("g")) / F.col("k")).withColumn("xi", -F.col("k")).drop("k", "g")


def gpd_from_lmoments(m: DataFrame) -> DataFrame:
    """scale and shape of excesses over zero from their first two L-moments."""
    k = F.col("l1") / F.col("l2") - 2
    return m.select("*", ((1 + k) * F.col("l1")).alias("scale"), (-k).alias("shape"))


def return_levels(params: DataFrame, periods: list[float], level) -> DataFrame:
    """One row for each row of params and return period; level is a function of the period's Column."""
    return params.withColumn("period", F.explode(F.array(*[F.lit(float(t)) for t in periods]))).withColumn("level", level(F.col("period")))


def ratio_in(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


# Kernels: one group, a station's blocks, is one small array.


def _gev_nll(theta: np.ndarray, x: np.ndarray) -> float:
    mu, log_sigma, xi = theta
    if not -0.5 < xi < 0.8 or abs(log_sigma) > 50:
        return 1e300
    s = np.exp(log_sigma)
    z = (x - mu) / s
    if abs(xi) < 1e-6:
        return float(len(x) * log_sigma + z.sum() + np.exp(-z).sum())
    w = 1 + xi * z
    if (w <= 0).any():
        return 1e300
    return float(len(x) * log_sigma + (1 + 1 / xi) * np.log(w).sum() + (w ** (-1 / xi)).sum())


def _gpd_nll(theta: np.ndarray, x: np.ndarray) -> float:
    log_scale, xi = theta
    if not -0.5 < xi < 1.0 or abs(log_scale) > 50:
        return 1e300
    s = np.exp(log_scale)
    if abs(xi) < 1e-6:
        return float(len(x) * log_scale + x.sum() / s)
    w = 1 + xi * x / s
    if (w <= 0).any():
        return 1e300
    return float(len(x) * log_scale + (1 + 1 / xi) * np.log(w).sum())


def simplex(f, start: np.ndarray, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Downhill simplex minimum of f; plain and without derivatives."""
    n = len(start)
    pts = [start] + [start + np.eye(n)[k] * (0.1 * abs(start[k]) + 0.05) for k in range(n)]
    val = [f(p) for p in pts]
    for _ in range(rounds):
        order = np.argsort(val, kind="stable")
        pts, val = [pts[k] for k in order], [val[k] for k in order]
        if abs(val[-1] - val[0]) < 1e-10 * (1 + abs(val[0])):
            break
        mid = np.mean(pts[:-1], axis=0)
        far = mid + (mid - pts[-1])
        got = f(far)
        if got < val[0]:
            further = mid + 2 * (mid - pts[-1])
            more = f(further)
            pts[-1], val[-1] = (further, more) if more < got else (far, got)
        elif got < val[-2]:
            pts[-1], val[-1] = far, got
        else:
            near = mid + 0.5 * ((far if got < val[-1] else pts[-1]) - mid)
            less = f(near)
            if less < min(got, val[-1]):
                pts[-1], val[-1] = near, less
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    k = int(np.argmin(val))
    return pts[k], val[k]


def _l_ratios(x: np.ndarray) -> tuple[float, float, float]:
    """Mean, L-scale and L-skewness of a sample."""
    v = np.sort(x)
    n, i = len(v), np.arange(len(v))
    b0, b1, b2 = v.mean(), (i * v).sum() / (n * (n - 1)), (i * (i - 1) * v).sum() / (n * (n - 1) * max(n - 2, 1))
    l2 = 2 * b1 - b0
    return float(b0), float(l2), float((6 * b2 - 6 * b1 + b0) / l2) if l2 > 0 else 0.0


def _shapes(first: float) -> list[float]:
    """Starting shapes around an estimate by L-moments, and the one without a tail."""
    first = float(np.clip(first, -0.45, 0.45))
    return [0.0, first, first - 0.15, first + 0.15]


def gev_mle_of(x: np.ndarray) -> tuple[float, float, float, float]:
    """(mu, sigma, xi, negative log-likelihood) with the best of several starting shapes."""
    s = max(float(np.std(x)) * 6**0.5 / np.pi, 1e-9)
    m = float(np.mean(x)) - 0.5772 * s
    c = 2 / (3 + _l_ratios(x)[2]) - np.log(2) / np.log(3)
    xi0 = -(7.859 * c + 2.9554 * c * c)
    best = min((simplex(lambda p: _gev_nll(np.array([p[0] * s + m, p[1] + np.log(s), p[2]]), x), np.array([0.0, 0.0, xi])) for xi in _shapes(xi0)), key=lambda r: r[1])
    p = best[0]
    return p[0] * s + m, float(np.exp(p[1]) * s), float(p[2]), best[1]


def gpd_mle_of(x: np.ndarray) -> tuple[float, float, float]:
    s = max(float(np.mean(x)), 1e-9)
    l1, l2, _ = _l_ratios(x)
    best = min((simplex(lambda p: _gpd_nll(np.array([p[0] + np.log(s), p[1]]), x), np.array([0.0, xi or 0.01])) for xi in _shapes(2 - l1 / l2 if l2 > 0 else 0.0)), key=lambda r: r[1])
    return float(np.exp(best[0][0]) * s), float(best[0][1]), best[1]


def gev_mle(df: DataFrame, group: str = "series_id") -> DataFrame:
    """(group, mu, sigma, xi, nll, n) by maximum likelihood; groups of fewer than five values are left out."""

    def fit(x: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(x["value"].dropna().to_numpy(float))
        if len(v) < 5:
            return pd.DataFrame(columns=[group, "mu", "sigma", "xi", "nll", "n"])
        return pd.DataFrame([(x[group].iloc[0], *gev_mle_of(v), len(v))], columns=[group, "mu", "sigma", "xi", "nll", "n"])

    return df.select(group, "value").groupBy(group).applyInPandas(fit, f"`{group}` string, mu double, sigma double, xi double, nll double, n long")


def gpd_mle(excesses: DataFrame, group: str = "series_id") -> DataFrame:
    """(group, scale, shape, nll, n) of values over zero, with the location held at zero."""

    def fit(x: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(x["value"].dropna().to_numpy(float))
        if len(v) < 5:
            return pd.DataFrame(columns=[group, "scale", "shape", "nll", "n"])
        return pd.DataFrame([(x[group].iloc[0], *gpd_mle_of(v), len(v))], columns=[group, "scale", "shape", "nll", "n"])

    return excesses.select(group, "value").groupBy(group).applyInPandas(fit, f"`{group}` string, scale double, shape double, nll double, n long")


def _name_seed(name) -> int:
    """A seed of a group's name, so that groups draw independently."""
    return crc32(str(name).encode())


def return_level_ci(df: DataFrame, period: float, draws: int = 500, seed: int = 0, group: str = "series_id") -> DataFrame:
    """(group, median, lower, upper): bootstrap interval of the L-moment GEV level. Each draw is a row, seeded by its number
    and its group, so the result does not depend on partitions and groups are independent."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, values, k in b.itertuples(index=False):
                v = np.sort(np.asarray(values, float))
                g = np.random.Generator(np.random.PCG64([seed, k, _name_seed(name)]))
                s = np.sort(g.choice(v, len(v)))
                out.append((name, k, _lmom_level(s, period)))
            yield pd.DataFrame(out, columns=[group, "draw", "level"])

    sets = df.groupBy(group).agg(F.sort_array(F.collect_list("value")).alias("v"))
    rows = sets.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws)))).repartition(F.col("draw"))
    levels = rows.select(group, "v", "draw").mapInPandas(draw, f"`{group}` string, draw int, level double")
    return levels.groupBy(group).agg(F.percentile("level", 0.5).alias("median"), F.percentile("level", 0.025).alias("lower"), F.percentile("level", 0.975).alias("upper"))


def _lmom_level(v: np.ndarray, period: float) -> float:
    from math import gamma, log

    n = len(v)
    j = np.arange(n)
    b0, b1, b2 = v.mean(), (j * v).sum() / (n * (n - 1)), (j * (j - 1) * v).sum() / (n * (n - 1) * (n - 2))
    l2, l3 = 2 * b1 - b0, 6 * b2 - 6 * b1 + b0
    c = 2 / (3 + l3 / l2) - log(2) / log(3)
    k = 7.859 * c + 2.9554 * c * c
    k = 1e-6 if abs(k) < 1e-6 else k
    s = l2 * k / ((1 - 2**-k) * gamma(1 + k))
    return float(b0 - s * (1 - gamma(1 + k)) / k + s / k * (1 - (-log(1 - 1 / period)) ** k))


FAMILIES = ("gev", "gumbel", "lognormal", "gamma", "exponential", "normal", "weibull")


def marginal_fit(name: str, x: np.ndarray) -> tuple[float, int, tuple[float, float, float]]:
    """Negative log-likelihood at the fit, the number of parameters, and (a, b, c) as functions.marginals has them."""
    from math import lgamma

    from ..functions import special

    n, none = len(x), (0.0, 0.0, 0.0)
    if name == "gev":
        mu, s, xi, nll = gev_mle_of(x)
        return nll, 3, (float(mu), float(s), float(xi))
    if name == "gumbel":
        s = max(float(np.std(x)) * 6**0.5 / np.pi, 1e-9)
        p, nll = simplex(lambda p: _gev_nll(np.array([p[0], p[1], 0.0]), x), np.array([float(np.mean(x)) - 0.5772 * s, np.log(s)]))
        return nll, 2, (float(p[0]), float(np.exp(p[1])), 0.0)
    if name == "normal":
        s = max(float(np.std(x)), 1e-12)
        return n / 2 * np.log(2 * np.pi * s * s) + n / 2, 2, (float(np.mean(x)), s, 0.0)
    if (x <= 0).any():
        return float("inf"), 2, none
    if name == "lognormal":
        y = np.log(x)
        s = max(float(np.std(y)), 1e-12)
        return float(n / 2 * np.log(2 * np.pi * s * s) + n / 2 + y.sum()), 2, (float(y.mean()), s, 0.0)
    if name == "gamma":
        k, s = special.gamma_mle(x)
        return float(n * (lgamma(k) + k * np.log(s)) - (k - 1) * np.log(x).sum() + x.sum() / s), 2, (float(k), float(s), 0.0)
    if name == "exponential":
        return float(n * np.log(x.mean()) + n), 1, (float(x.mean()), 0.0, 0.0)
    p, nll = simplex(lambda p: float(-n * p[0] + n * np.exp(p[0]) * p[1] - (np.exp(p[0]) - 1) * np.log(x).sum() + ((x / np.exp(p[1])) ** np.exp(p[0])).sum()) if abs(p[0]) < 5 and abs(p[1]) < 60 else 1e300, np.array([0.0, np.log(x.mean())]))
    return nll, 2, (float(np.exp(p[0])), float(np.exp(p[1])), 0.0)


def best_marginal(df: DataFrame, families: tuple[str, ...] = FAMILIES, group: str = "series_id") -> DataFrame:
    """(group, family, bic): the family of the lowest Bayesian information criterion; unknown names are refused."""
    unknown = set(families) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown families {sorted(unknown)}")

    def fit(x: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(x["value"].dropna().to_numpy(float))
        if len(v) < 5:
            return pd.DataFrame(columns=[group, "family", "bic"])
        rows = []
        for f in families:
            nll, k, _ = marginal_fit(f, v)
            if np.isfinite(nll) and nll < 1e299:
                rows.append((2 * nll + k * np.log(len(v)), f))
        bic, name = min(rows)
        return pd.DataFrame([(x[group].iloc[0], name, bic)], columns=[group, "family", "bic"])

    return df.select(group, "value").groupBy(group).applyInPandas(fit, f"`{group}` string, family string, bic double")


def _hessian(f, x: np.ndarray) -> np.ndarray:
    n = len(x)
    h = 1e-4 * (np.abs(x) + 1e-2)
    e = np.diag(h)
    out = np.empty((n, n))
    for i in range(n):
        for j in range(n):
            out[i, j] = (f(x + e[i] + e[j]) - f(x + e[i] - e[j]) - f(x - e[i] + e[j]) + f(x - e[i] - e[j])) / (4 * h[i] * h[j])
    return out


def gev_fisher(df: DataFrame, draws: int = 200, seed: int = 0, group: str = "series_id") -> DataFrame:
    """(group, draw, mu, sigma, xi): normal draws around the fit with the inverse Hessian as covariance; draws of a
    negative scale are left out."""

    def fit(x: pd.DataFrame) -> pd.DataFrame:
        cols = [group, "draw", "mu", "sigma", "xi"]
        v = np.sort(x["value"].dropna().to_numpy(float))
        if len(v) < 5:
            return pd.DataFrame(columns=cols)
        mu, s, xi, _ = gev_mle_of(v)
        p = np.array([mu, s, xi])
        h = _hessian(lambda q: _gev_nll(np.array([q[0], np.log(max(q[1], 1e-12)), q[2]]), v), p)
        w, b = np.linalg.eigh(np.nan_to_num((h + h.T) / 2, nan=1.0, posinf=1e12, neginf=-1e12))
        root = b / np.sqrt(np.maximum(w, np.max(np.abs(w)) * 1e-12))
        g = np.random.Generator(np.random.PCG64([seed, _name_seed(x[group].iloc[0])]))
        d = p + g.standard_normal((draws, 3)) @ root.T
        keep = d[:, 1] > 0
        return pd.DataFrame({group: x[group].iloc[0], "draw": np.flatnonzero(keep), "mu": d[keep, 0], "sigma": d[keep, 1], "xi": d[keep, 2]})

    return df.select(group, "value").groupBy(group).applyInPandas(fit, f"`{group}` string, draw long, mu double, sigma double, xi double")


def gev_mcmc(df: DataFrame, draws: int = 1000, warmup: int = 500, shape_sd: float = 0.2, seed: int = 0, group: str = "series_id") -> DataFrame:
    """(group, draw, mu, sigma, xi): a random-walk Metropolis chain with a normal prior on the shape; one chain a group."""

    def fit(x: pd.DataFrame) -> pd.DataFrame:
        cols = [group, "draw", "mu", "sigma", "xi"]
        v = np.sort(x["value"].dropna().to_numpy(float))
        if len(v) < 5:
            return pd.DataFrame(columns=cols)
        mu, s, xi, _ = gev_mle_of(v)
        f = lambda p: -_gev_nll(p, v) - 0.5 * (p[2] / shape_sd) ** 2
        p = np.array([mu, np.log(s), xi])
        step = np.array([s, 1.0, 0.7]) / len(v) ** 0.5
        g = np.random.Generator(np.random.PCG64([seed, _name_seed(x[group].iloc[0])]))
        at, out = f(p), []
        for k in range(draws + warmup):
            q = p + step * g.standard_normal(3)
            new = f(q)
            if np.log(g.uniform()) < new - at:
                p, at = q, new
            if k >= warmup:
                out.append((x[group].iloc[0], k - warmup, p[0], float(np.exp(p[1])), p[2]))
        return pd.DataFrame(out, columns=cols)

    return df.select(group, "value").groupBy(group).applyInPandas(fit, f"`{group}` string, draw long, mu double, sigma double, xi double")


def posterior_levels(samples: DataFrame, period: float, group: str = "series_id") -> DataFrame:
    """(group, median, lower, upper) of the level over parameter samples."""
    level = dist.gev_level(period, "mu", "sigma", "xi")
    return samples.select(group, level.alias("l")).where("NOT isnan(l) AND abs(l) < double('infinity')").groupBy(group).agg(F.percentile("l", 0.5).alias("median"), F.percentile("l", 0.025).alias("lower"), F.percentile("l", 0.975).alias("upper"))
