"""Regional frequency analysis over (station, year, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import extremes as ex
from ..functions import distributions as dist

# fixed values: critical discordancy for 5 to 14 sites; 3 beyond
CRITICAL = {5: 1.333, 6: 1.648, 7: 1.917, 8: 2.140, 9: 2.329, 10: 2.491, 11: 2.632, 12: 2.757, 13: 2.869, 14: 2.971}


def index_flood(df: DataFrame) -> DataFrame:
    """Values over their station's mean, beside that mean."""
    mean = df.groupBy("station").agg(F.avg("value").alias("index_flood"))
    return df.join(mean, "station").withColumn("normalised", F.col("value") / F.col("index_flood"))


def regional_levels(df: DataFrame, periods: list[float]) -> DataFrame:
    """(station, period, level): the pooled GEV growth curve times the station's index flood."""
    n = index_flood(df).withColumn("region", F.lit("all"))
    fit = ex.gev_from_lmoments(ex.lmoments(n, "region", "normalised"))
    growth = ex.return_levels(fit, periods, lambda t: dist.gev_level(t, "mu", "sigma", "xi")).select("period", F.col("level").alias("growth"))
    means = n.select("station", "index_flood").distinct()
    return means.join(F.broadcast(growth)).select("station", "period", (F.col("index_flood") * F.col("growth")).alias("level"))  # one row for each period


def discordancy(df: DataFrame) -> DataFrame:
    """(station, n, t, t3, t4, d, discordant): distance of each site's L-moment ratios from the region's mean in the
    metric of their scatter. The 3 x 3 scatter matrix is inverted by cofactors, in columns."""
    m = ex.lmoments(df, "station").where("t4 IS NOT NULL")
    cols = ("t", "t3", "t4")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    s = m.agg(F.count("*").alias("sites"), *(F.avg(c).alias(f"m_{c}") for c in cols), *((F.covar_pop(a, b) * F.count("*") / (F.count("*") - 1)).alias(f"s_{a}_{b}") for a, b in pairs))
    x = m.join(F.broadcast(s))  # one row
    for c in cols:
        x = x.withColumn(f"d_{c}", F.col(c) - F.col(f"m_{c}"))
    e = F.expr
    x = x.selectExpr("*", "s_t_t AS a", "s_t_t3 AS b", "s_t_t4 AS c", "s_t3_t3 AS e", "s_t3_t4 AS f", "s_t4_t4 AS i", "d_t AS p", "d_t3 AS q", "d_t4 AS r")
    det = e("a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c)")
    form = e("p * p * (e * i - f * f) + q * q * (a * i - c * c) + r * r * (a * e - b * b) + 2 * (p * q * (c * f - b * i) + p * r * (b * f - c * e) + q * r * (b * c - a * f))")
    d = F.col("sites") / (3 * (F.col("sites") - 1)) * form / det
    critical = F.coalesce(*[F.when(F.col("sites") == k, F.lit(v)) for k, v in CRITICAL.items()], F.lit(3.0))
    return x.withColumn("d", d).select("station", "n", "t", "t3", "t4", "d", (F.col("d") > critical).alias("discordant"))


def weighted_dispersion(df: DataFrame) -> DataFrame:
    """(v): record-length-weighted root mean square deviation of the sites' L-CV."""
    m = ex.lmoments(df, "station")
    mean = m.agg((F.sum(F.col("n") * F.col("t")) / F.sum("n")).alias("mean"))
    return m.join(F.broadcast(mean)).agg(F.sqrt(F.sum(F.col("n") * F.pow(F.col("t") - F.col("mean"), 2)) / F.sum("n")).alias("v"))


def heterogeneity(df: DataFrame, n_sim: int = 500, seed: int = 0) -> DataFrame:
    """(h1, v, mean, sd): the dispersion of L-CV against that of simulated homogeneous regions of the same record
    lengths, drawn from the regional GEV. Simulations are rows with their own seeds."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    n = index_flood(df).withColumn("region", F.lit("all"))
    fit = ex.gev_from_lmoments(ex.lmoments(n, "region", "normalised")).select("mu", "sigma", "xi").first()
    sizes = [r.n for r in df.groupBy("station").agg(F.count("*").alias("n")).orderBy("station").collect()]  # one number for each station

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k in b["id"]:
                g = np.random.Generator(np.random.PCG64([seed, int(k)]))
                t = []
                for m in sizes:
                    y = -np.log(g.uniform(size=m))
                    x = np.sort(fit.mu - fit.sigma * np.log(y) if abs(fit.xi) < 1e-6 else fit.mu + fit.sigma / fit.xi * (y**-fit.xi - 1))
                    b1 = (np.arange(m) * x).sum() / (m * (m - 1))
                    t.append((2 * b1 - x.mean()) / x.mean())
                w = np.array(sizes) / sum(sizes)
                t = np.array(t)
                out.append(((w * (t - (w * t).sum()) ** 2).sum()) ** 0.5)
            yield pd.DataFrame({"v": out})

    sims = df.sparkSession.range(n_sim).mapInPandas(simulate, "v double").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    return weighted_dispersion(df).join(F.broadcast(sims)).select(((F.col("v") - F.col("mean")) / F.col("sd")).alias("h1"), "v", "mean", "sd")
