"""Joint distributions: fitted marginals as rows, level curves of copulas, design events and ensembles, three variables.

A marginal is a row (family, a, b, c), see functions.marginals; a copula is a family and a parameter column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..functions import marginals as mg

#: Halvings of the root search on a level curve.
HALVINGS = 50


def fit_marginals(df: DataFrame, columns: list[str], families: tuple[str, ...] = ("gev", "lognormal", "gamma"), group: str = "series_id", least: int = 5) -> DataFrame:
    """(group, variable, family, a, b, c, aic, n): the family of the lowest Akaike criterion for each column and group.

    Nulls are left out; a column of fewer than least values, or one that no family fits, has no row."""
    from .extremes import FAMILIES, marginal_fit

    unknown = set(families) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown families {sorted(unknown)}")
    names = [group, "variable", "family", "a", "b", "c", "aic", "n"]

    def fit(x: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(x["value"].to_numpy(float))
        found = []
        for f in families if len(v) >= least else ():
            nll, k, p = marginal_fit(f, v)
            if np.isfinite(nll) and nll < 1e299:
                found.append((2 * k + 2 * nll, f, *p))
        if not found:
            return pd.DataFrame(columns=names)
        aic, f, a, b, c = min(found)
        return pd.DataFrame([(x[group].iloc[0], x["variable"].iloc[0], f, a, b, c, aic, len(v))], columns=names)

    long = df.select(group, F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns))).alias("r"))
    long = long.select(F.col(group).cast("string").alias(group), "r.variable", "r.value").where("value IS NOT NULL AND NOT isnan(value)")
    return long.groupBy(group, "variable").applyInPandas(fit, f"`{group}` string, variable string, family string, a double, b double, c double, aic double, n long")


def discrete_marginal(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, value, p, cumulative): shares of the values of each group, nulls left out."""
    n = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("value")).agg(F.count("*").alias("k"))
    total = n.groupBy(group).agg(F.sum("k").alias("n"))
    so_far = F.sum("k").over(Window.partitionBy(group).orderBy("value"))
    return n.join(total, group).select(group, "value", (F.col("k") / F.col("n")).alias("p"), (so_far / F.col("n")).alias("cumulative"))


def through_marginal(df: DataFrame, value: str, out: str, what: str = "cdf") -> DataFrame:
    """df with out: cdf (held within 1e-10 of 0 and 1), quantile or density of value under the row's family, a, b, c."""
    if what not in ("cdf", "quantile", "density"):
        raise ValueError("what must be cdf, quantile or density")

    @F.pandas_udf("double")
    def apply(x: pd.Series, family: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        got = np.full(len(x), np.nan)
        rows = pd.DataFrame({"f": family, "a": a, "b": b, "c": c})
        for (f, p, q, r), at in rows.groupby(["f", "a", "b", "c"]).indices.items():
            y = getattr(mg, what)(f, x.to_numpy(float)[at], p, q, r)
            got[at] = np.clip(y, 1e-10, 1 - 1e-10) if what == "cdf" else y
        return pd.Series(got)

    return df.withColumn(out, F.nanvl(apply(F.col(value).cast("double"), "family", "a", "b", "c"), F.lit(None).cast("double")))


def copula_density(family: str, theta, u, v) -> Column:
    """c(u, v), the mixed derivative of the Gumbel, Clayton or Frank copula."""
    th, u, v = dist._c(theta), *(F.greatest(F.lit(1e-10), F.least(dist._c(x), F.lit(1 - 1e-10))) for x in (u, v))
    if family == "clayton":
        return (1 + th) * F.pow(u * v, -1 - th) * F.pow(F.pow(u, -th) + F.pow(v, -th) - 1, -2 - 1 / th)
    if family == "gumbel":
        x, y = -F.log(u), -F.log(v)
        s = F.pow(x, th) + F.pow(y, th)
        r = F.pow(s, 1 / th)
        return F.exp(-r) / (u * v) * F.pow(x * y, th - 1) * F.pow(s, 2 / th - 2) * (1 + (th - 1) / r)
    if family == "frank":
        e = 1 - F.exp(-th)
        rest = e - (1 - F.exp(-th * u)) * (1 - F.exp(-th * v))
        return F.when(F.abs(th) < 1e-8, F.lit(1.0)).otherwise(th * e * F.exp(-th * (u + v)) / (rest * rest))
    raise ValueError(f"unknown family {family!r}")


def _probability(family: str, theta, u: Column, v: Column, scenario: str) -> Column:
    c = dist.copula_cdf(family, theta, u, v)
    return 1 - c if scenario == "or" else 1 - u - v + c


def contour(params: DataFrame, family: str, period: float, scenario: str = "or", n: int = 300, theta: str = "theta") -> DataFrame:
    """Each row of params with n points (i, u, v) of its level curve: those exceeded once in period events on average.

    Or: C(u, v) = 1 - 1/period, for u from there to 1; and: 1 - u - v + C(u, v) = 1/period, for u from 0 to 1 - 1/period.
    For each u the level falls or rises in v alone, so v is found by halving; points without a solution are left out."""
    if scenario not in ("or", "and"):
        raise ValueError("scenario must be 'or' or 'and'")
    p = 1 / period
    low, high = (1 - p + 1e-4, 1 - 1e-4) if scenario == "or" else (1e-4, max(1 - p - 1e-4, 2e-4))
    at = params.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("u", F.lit(low) + F.col("i") * ((high - low) / max(n - 1, 1)))
    gap = lambda v: _probability(family, theta, F.col("u"), v, scenario) - p  # noqa: E731  falls as v rises

    def halve(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        above = gap(mid) > 0
        return F.struct(F.when(above, mid).otherwise(s["low"]).alias("low"), F.when(above, s["high"]).otherwise(mid).alias("high"))

    ends = F.struct(F.lit(1e-10).alias("low"), F.lit(1 - 1e-10).alias("high"))
    found = at.where((gap(F.lit(1e-10)) >= 0) & (gap(F.lit(1 - 1e-10)) <= 0))
    return found.withColumn("v", F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), ends, halve)["low"])


def curve_in_units(curve: DataFrame, x: DataFrame, y: DataFrame, key: str) -> DataFrame:
    """The curve with x and y, the quantiles of u and v, and the joint marginal density fxfy.

    x and y are marginals (key, family, a, b, c), one row a key."""
    d = curve
    for value, out, m in (("u", "x", x), ("v", "y", y)):
        d = d.join(m.select(key, "family", "a", "b", "c"), key)
        d = through_marginal(through_marginal(d, value, out, "quantile"), out, f"_f{out}", "density").drop("family", "a", "b", "c")
    return d.withColumn("fxfy", F.col("_fx") * F.col("_fy")).drop("_fx", "_fy")


def most_probable(curve: DataFrame, family: str, key: str, theta: str = "theta") -> DataFrame:
    """(key, x, y, u, v): the point of each curve in units with the highest joint density; the first on ties."""
    d = curve.withColumn("_density", copula_density(family, theta, "u", "v") * F.col("fxfy")).where("_density IS NOT NULL AND NOT isnan(_density)")
    return d.groupBy(key).agg(F.max_by(F.struct("x", "y", "u", "v"), F.struct("_density", -F.col("i"))).alias("b")).select(key, "b.x", "b.y", "b.u", "b.v")


def kendall_level(pool: DataFrame, value: str, period: float, mu: float = 1.0) -> DataFrame:
    """(t): the copula value that a share 1 - mu/period of the pool does not exceed; mu is the years from event to event."""
    if not 0 < mu < period:
        raise ValueError("period must exceed mu")
    return pool.agg(F.percentile(value, 1 - mu / period).alias("t"))


def design_ensemble(pool: DataFrame, family: str, theta: float, u: str, v: str, period: float, n: int = 50, mu: float = 1.0, width: float = 0.05) -> DataFrame:
    """The n rows of pool of the highest copula density among those whose copula value is near the Kendall level of period.

    Near is within width of the level, relatively; with fewer than n such rows, the band doubles until it holds n or all
    rows of a positive value. One pass counts each band; ties go by (u, v)."""
    d = pool.withColumn("c", dist.copula_cdf(family, theta, u, v))
    level = kendall_level(d, "c", period, mu)
    off = d.join(F.broadcast(level)).withColumn("off", F.abs(F.col("c") - F.col("t")) / F.greatest("t", F.lit(1e-12)))  # one row
    bands = [width * 2**k for k in range(12)]
    held = off.agg(*(F.count(F.when(F.col("off") <= b, 1)).alias(f"n{k}") for k, b in enumerate(bands))).first()
    band = next((b for k, b in enumerate(bands) if held[k] >= n), bands[-1])
    return off.where(F.col("off") <= band).withColumn("density", copula_density(family, theta, u, v)).orderBy(F.desc("density"), u, v).limit(n).drop("t", "off")


def exceedance_of_three(df: DataFrame, family: str, theta: float, u: str, v: str, w: str) -> DataFrame:
    """df with p_or, p_and, t_or and t_and of three uniforms; the last by inclusion and exclusion."""
    pair = lambda a, b: dist.copula_cdf(family, theta, a, b)
    three = dist.copula_cdf(family, theta, u, v, w)
    every = 1 - F.col(u) - F.col(v) - F.col(w) + pair(u, v) + pair(u, w) + pair(v, w) - three
    d = df.withColumn("p_or", 1 - three).withColumn("p_and", F.greatest(F.lit(0.0), every))
    return d.withColumn("t_or", 1 / F.greatest("p_or", F.lit(1e-12))).withColumn("t_and", 1 / F.greatest("p_and", F.lit(1e-12)))
