"""Dependence of two or three series: rank correlations, Archimedean copulas, joint return periods, samplers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..functions.moments import correlation


def pseudo_observations(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Average ranks over n + 1 within a group, as u_<column>."""
    n = F.count("*").over(Window.partitionBy(group))
    for c in columns:
        w = Window.partitionBy(group).orderBy(c)
        ties = F.count("*").over(Window.partitionBy(group, c))
        df = df.withColumn(f"u_{c}", (F.rank().over(w) + (ties - 1) / 2) / (n + 1))
    return df


def spearman(df: DataFrame, x: str, y: str, group: str, least: int = 8) -> DataFrame:
    """(group, n, rho) by average ranks; groups of fewer than least pairs have none."""
    u = pseudo_observations(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), [x, y], group)
    return u.groupBy(group).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, correlation(f"u_{x}", f"u_{y}")).alias("rho"))


def kendall(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """(group, n, tau): tau-b, of pairs within a group by key equality; groups are records of one station pair."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, F.col(x).alias("x"), F.col(y).alias("y"), F.row_number().over(Window.partitionBy(group).orderBy(x, y)).alias("i"))
    a, b = d.alias("a"), d.alias("b")
    p = a.join(b, F.expr(f"a.`{group}` = b.`{group}` AND a.i < b.i")).select(f"a.{group}", F.expr("signum(b.x - a.x)").alias("sx"), F.expr("signum(b.y - a.y)").alias("sy"))
    s = p.groupBy(group).agg(F.sum(F.col("sx") * F.col("sy")).alias("s"), F.sum(F.abs("sx")).alias("nx"), F.sum(F.abs("sy")).alias("ny"), F.count("*").alias("m"))
    return s.select(group, ((1 + F.sqrt(1 + 8 * F.col("m"))) / 2).cast("long").alias("n"), F.expr("try_divide(s, sqrt(nx * ny))").alias("tau"))


def theta_of_tau(df: DataFrame) -> DataFrame:
    """Gumbel and Clayton parameters of tau, with tail dependence."""
    t = df.withColumn("theta_gumbel", F.greatest(F.lit(1.001), 1 / (1 - F.least("tau", F.lit(0.999))))).withColumn("theta_clayton", F.greatest(F.lit(1e-4), 2 * F.col("tau") / (1 - F.least("tau", F.lit(0.999)))))
    return t.withColumn("upper_gumbel", dist.tail_dependence("gumbel", "theta_gumbel")[1]).withColumn("lower_clayton", dist.tail_dependence("clayton", "theta_clayton")[0])


def joint_exceedance(df: DataFrame, family: str, theta: float, u: str, v: str) -> DataFrame:
    """df with p_or, p_and, and return periods in events."""
    c = dist.copula_cdf(family, theta, u, v)
    d = df.withColumn("c", c).withColumn("p_or", 1 - F.col("c")).withColumn("p_and", F.greatest(F.lit(0.0), 1 - F.col(u) - F.col(v) + F.col("c")))
    return d.withColumn("t_or", 1 / F.greatest("p_or", F.lit(1e-12))).withColumn("t_and", 1 / F.greatest("p_and", F.lit(1e-12)))


def kendall_function(df: DataFrame, value: str, grid: list[float]) -> DataFrame:
    """(t, k): share of values at or below each t of the grid; the grid is a literal, so one pass counts all of it."""
    counts = df.agg(F.count(value).alias("n"), *(F.count(F.when(F.col(value) <= t, 1)).alias(f"c{i}") for i, t in enumerate(grid)))
    return counts.select("n", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col(f"c{i}").alias("c")) for i, t in enumerate(grid)))).alias("x")).select("x.t", (F.col("x.c") / F.col("n")).alias("k"))


def sample(spark: SparkSession, family: str, theta: float, n: int, seed: int = 0, dims: int = 2) -> DataFrame:
    """(draw, u array): n draws; each row's generator is seeded by (seed, block), so partitions do not matter."""
    block = 4096

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                g = np.random.Generator(np.random.PCG64([seed, b]))
                m = min(block, n - b * block)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(m) + b * block), pa.FixedSizeListArray.from_arrays(pa.array(_draw(family, theta, m, dims, g).reshape(-1)), dims).cast(pa.list_(pa.float64()))], ["draw", "u"])

    return spark.range(-(-n // block)).mapInArrow(draw, "draw bigint, u array<double>")


def _draw(family: str, theta: float, m: int, dims: int, g: np.random.Generator) -> np.ndarray:
    e = g.exponential(size=(m, dims))
    if family == "gumbel":
        if theta < 1.01:
            return g.uniform(size=(m, dims))
        a = 1 / theta
        x = g.uniform(1e-12, np.pi, size=m)
        w = g.exponential(size=m)
        s = np.sin(a * x) / np.sin(x) ** (1 / a) * (np.sin((1 - a) * x) / w) ** ((1 - a) / a)  # positive stable frailty
        return np.exp(-((e / s[:, None]) ** a))
    if family == "clayton":
        if theta < 1e-4:
            return g.uniform(size=(m, dims))
        return (1 + e / g.gamma(1 / theta, size=m)[:, None]) ** (-1 / theta)
    if family == "frank":
        if abs(theta) < 1e-8:
            return g.uniform(size=(m, dims))
        if theta < 0:  # no frailty exists; two variables follow by the inverse of the conditional distribution
            if dims != 2:
                raise ValueError("a negative Frank parameter needs two variables")
            u, p = g.uniform(size=(2, m))
            v = -np.log1p(p * np.expm1(-theta) / (p + (1 - p) * np.exp(-theta * u))) / theta
            return np.stack([u, v], axis=1)
        s = g.logseries(1 - np.exp(-theta), size=m)
        return -np.log1p(-(1 - np.exp(-theta)) * np.exp(-e / s[:, None])) / theta
    if family == "gaussian":
        from statistics import NormalDist

        c = np.full((dims, dims), theta)
        np.fill_diagonal(c, 1.0)
        z = g.standard_normal((m, dims)) @ np.linalg.cholesky(c).T
        return np.vectorize(NormalDist().cdf)(z)
    raise ValueError(f"unknown family {family!r}")
