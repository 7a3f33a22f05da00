"""Raster ensembles (sim, cell, depth), order statistics of pixels, and soil classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import correlation

PERIODS = (5, 10, 25, 50, 100, 200, 500, 1000)


def spatial_stats(df: DataFrame) -> DataFrame:
    """(cell, n, mean, median, std, max) of the wet simulations."""
    return df.where("depth IS NOT NULL").groupBy("cell").agg(F.count("*").alias("n"), F.avg("depth").alias("mean"), F.median("depth").alias("median"), F.stddev_pop("depth").alias("std"), F.max("depth").alias("max"))


def flooded_area(df: DataFrame, cell_area: float, threshold: float = 0.0) -> DataFrame:
    return df.groupBy("sim").agg((F.count(F.when(F.col("depth") >= threshold, 1)) * F.lit(cell_area)).alias("area"), F.avg("depth").alias("depth_mean"))


def inundation_frequency(df: DataFrame) -> DataFrame:
    return df.groupBy("cell").agg(F.avg(F.col("depth").isNotNull().cast("double")).alias("frequency"))


def flooded_between(df: DataFrame, cell_area: float, low: float, high: float) -> DataFrame:
    """(sim, area): cells deeper than low and less deep than high; simulations without any have area 0."""
    return df.groupBy("sim").agg((F.count(F.when((F.col("depth") > low) & (F.col("depth") < high), 1)) * F.lit(cell_area)).alias("area"))


def exclusive_zone(df: DataFrame, regimes: DataFrame) -> DataFrame:
    """(cell, wet_a, wet_b, difference, only): share of the simulations of regime 0 and 1, of (sim, regime), that wet a
    cell, b less a, and the regime if but one of them wets it. A cell without simulations of a regime has a null share."""
    wet = F.col("depth").isNotNull().cast("double")
    d = df.join(F.broadcast(regimes), "sim").groupBy("cell").agg(*(F.avg(F.when(F.col("regime") == k, wet)).alias(c) for k, c in enumerate(("wet_a", "wet_b"))))  # a row for each simulation
    only = F.when((F.col("wet_a") > 0) & (F.col("wet_b") == 0), 0).when((F.col("wet_b") > 0) & (F.col("wet_a") == 0), 1)
    return d.withColumns({"difference": F.col("wet_b") - F.col("wet_a"), "only": only})


def weighted_roughness(df: DataFrame, table: dict[int, float], key: str, code: str, weight: str) -> DataFrame:
    """(key, roughness): mean roughness of a key's land-use codes by weight; unknown codes and null weights do not count."""
    d = roughness(df, table, code).where(F.col("roughness").isNotNull())
    return d.groupBy(key).agg(F.try_divide(F.sum(F.col(weight) * F.col("roughness")), F.sum(weight)).alias("roughness"))


def area_regression(df: DataFrame, predictor: str, response: str) -> DataFrame:
    """(slope, intercept, r2, pearson) of two columns."""
    x, y = F.col(predictor).cast("double"), F.col(response).cast("double")
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), correlation(x, y).alias("pearson"))


def mad_outliers(df: DataFrame, metrics: list[str], key: str = "sim", limit: float = 3.0) -> DataFrame:
    """(key, metric, z): simulations whose robust z of a metric exceeds limit, each with its first such metric. Metrics
    whose median absolute deviation is zero are left out."""
    long = df.select(key, F.explode(F.array(*(F.struct(F.lit(i).alias("o"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for i, m in enumerate(metrics)))).alias("x")).select(key, "x.*").where("v IS NOT NULL")
    med = long.groupBy("metric").agg(F.median("v").alias("med"))
    d = long.join(F.broadcast(med), "metric").withColumn("dev", F.abs(F.col("v") - F.col("med")))  # a row for each metric
    mad = d.groupBy("metric").agg(F.median("dev").alias("mad")).where("mad > 0")
    z = d.join(F.broadcast(mad), "metric").withColumn("z", F.col("dev") / (1.4826 * F.col("mad"))).where(F.col("z") > limit)
    return z.groupBy(key).agg(F.min(F.struct("o", "metric", "z")).alias("b")).select(key, "b.metric", "b.z")


def reconstruct(weights: DataFrame, raster: DataFrame) -> DataFrame:
    """(event, cell, depth): weighted sums of simulated depths, from (event, sim, weight); dry counts as zero."""
    return weights.join(raster, "sim").groupBy("event", "cell").agg(F.sum(F.col("weight") * F.coalesce("depth", F.lit(0.0))).alias("depth"))


def pixel_return_period(df: DataFrame, rate: float, periods: tuple = PERIODS, key: str = "cell", value: str = "depth") -> DataFrame:
    """(cell, period, depth): the order statistic round-half-even(N (1 - 1 / (T rate))) - 1 of each pixel's values,
    held inside 0 and N - 1."""
    w = Window.partitionBy(key)
    r = df.where(F.col(value).isNotNull()).select(key, F.col(value).alias("depth"), (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    r = r.withColumn("period", F.explode(F.array(*map(F.lit, periods))))
    at = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.bround(F.col("n") * (1 - 1 / (F.col("period") * F.lit(rate)))).cast("long") - 1))
    return r.where(F.col("i") == at).select(key, "period", "depth")


# fixed values: the published USDA triangle, shares in per cent, from coarse to fine; the number is the class code
TEXTURES = [
    ("sand", 5, "silt + 1.5 * clay < 15"),
    ("loamy sand", 4, "silt + 1.5 * clay >= 15 AND silt + 2 * clay < 30"),
    ("sandy loam", 8, "silt + 2 * clay >= 30 AND (clay < 7 AND silt < 50 OR clay >= 7 AND clay < 20 AND sand > 52)"),
    ("loam", 3, "clay >= 7 AND clay < 27 AND silt >= 28 AND silt < 50 AND sand <= 52"),
    ("silt loam", 12, "silt >= 50 AND (clay >= 12 AND clay < 27 OR clay < 12 AND silt < 80)"),
    ("silt", 9, "silt >= 80 AND clay < 12"),
    ("sandy clay loam", 7, "clay >= 20 AND clay < 35 AND silt < 28 AND sand > 45"),
    ("clay loam", 2, "clay >= 27 AND clay < 40 AND sand > 20 AND sand <= 45"),
    ("silty clay loam", 11, "clay >= 27 AND clay < 40 AND sand <= 20"),
    ("sandy clay", 6, "clay >= 35 AND sand > 45"),
    ("silty clay", 10, "clay >= 40 AND silt >= 40"),
    ("clay", 1, "clay >= 40 AND sand <= 45 AND silt < 40"),
]


def texture_sql() -> str:
    """The class code of sand, silt and clay: 0 without data (255), else the greatest code whose condition holds, else 0.

    Shares that add up to 100 meet one condition; others may meet several."""
    codes = ", ".join(f"CASE WHEN {condition} THEN {code} ELSE 0 END" for _, code, condition in TEXTURES)
    return f"CASE WHEN sand = 255 OR silt = 255 OR clay = 255 THEN 0 ELSE greatest({codes}) END"


def soil_texture(df: DataFrame) -> DataFrame:
    return df.withColumn("texture", F.expr(texture_sql()))


def soil_mode(df: DataFrame) -> DataFrame:
    """(pixel, texture): the commonest class over depths, the smallest on ties."""
    n = soil_texture(df).groupBy("pixel", "texture").agg(F.count("*").alias("k"))
    return n.groupBy("pixel").agg(F.expr("min_by(texture, struct(-k, texture))").alias("texture"))


def roughness(df: DataFrame, table: dict[int, float], code: str) -> DataFrame:
    """df with the roughness of its land-use code; unknown codes are null."""
    lut: Column = reduce(lambda c, kv: c.when(F.col(code) == kv[0], F.lit(kv[1])), table.items(), F)  # a CASE, no join
    return df.withColumn("roughness", lut)
