"""Skill of simulations against observations, and quality of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import correlation


def skill(df: DataFrame, group: str = "series_id") -> DataFrame:
    """(group, n, nse, kge, pbias) over pairs without a null; a score whose denominator vanishes is null. One pass of
    sums, so any number of groups of any size shares one aggregation."""
    d = df.where("obs IS NOT NULL AND sim IS NOT NULL")
    s = d.groupBy(group).agg(F.count("*").alias("n"), F.var_pop("obs").alias("vo"), F.avg("obs").alias("mo"), F.avg("sim").alias("ms"), F.stddev_pop("obs").alias("so"), F.stddev_pop("sim").alias("ss"), correlation("obs", "sim").alias("r"), F.avg(F.pow(F.col("obs") - F.col("sim"), 2)).alias("mse"), F.sum("obs").alias("to"), F.sum(F.col("sim") - F.col("obs")).alias("te"))
    kge = F.expr("IF(so = 0 OR mo = 0, NULL, 1 - sqrt(pow(r - 1, 2) + pow(try_divide(ss, so) - 1, 2) + pow(try_divide(ms, mo) - 1, 2)))")
    return s.select(group, "n", F.expr("1 - try_divide(mse, vo)").alias("nse"), kge.alias("kge"), F.expr("100 * try_divide(te, to)").alias("pbias"))


def error_metrics(df: DataFrame, group: str, weight: str | None = None) -> DataFrame:
    """(group, rmse, mae, bias, r2, n) of (obs, sim), weighted if a weight column is given."""
    w = F.col(weight) if weight else F.lit(1.0)
    d = df.where("obs IS NOT NULL AND sim IS NOT NULL").withColumn("_w", w.cast("double")).withColumn("_e", F.col("sim") - F.col("obs"))
    s = d.groupBy(group).agg(F.sum("_w").alias("w"), F.sum(F.expr("_w * _e * _e")).alias("see"), F.sum(F.expr("_w * abs(_e)")).alias("sae"), F.sum(F.expr("_w * _e")).alias("se"), F.sum(F.expr("_w * obs")).alias("so"), F.sum(F.expr("_w * obs * obs")).alias("soo"), F.count("*").alias("n"))
    return s.select(group, F.expr("sqrt(see / w)").alias("rmse"), F.expr("sae / w").alias("mae"), F.expr("se / w").alias("bias"), F.expr("coalesce(1 - try_divide(see, soo - so * so / w), double('-infinity'))").alias("r2"), "n")


def series_quality(df: DataFrame) -> DataFrame:
    """(series_id, start_year, end_year, records, missing_pct, full_years, full_months, min, max)."""
    d = df.withColumn("y", F.year("ts")).withColumn("ok", F.col("value").isNotNull().cast("int"))
    months = d.groupBy("series_id", "y", F.month("ts").alias("m")).agg(F.sum("ok").alias("k"), F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    years = months.groupBy("series_id", "y").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.sum((F.col("k") >= 28).cast("int")).alias("months"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return years.groupBy("series_id").agg(F.min("y").alias("start_year"), F.max("y").alias("end_year"), F.sum("n").alias("records"), (100 * (1 - F.sum("k") / F.sum("n"))).alias("missing_pct"), F.sum((F.col("k") >= 365).cast("int")).alias("full_years"), F.sum("months").alias("full_months"), F.min("lo").alias("min"), F.max("hi").alias("max"))


def station_scores(stations: DataFrame, x: float, y: float) -> DataFrame:
    """(station, distance, score, place): completeness less a tenth of the distance; best first, nearer on ties.
    ``stations`` has (station, x, y, complete_pct)."""
    d = stations.withColumn("distance", F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2)))
    d = d.withColumn("score", F.col("complete_pct") - 0.1 * F.col("distance"))
    return d.select("station", "distance", "score")


def flow_duration(df: DataFrame) -> DataFrame:
    """(series_id, value, exceedance): values in falling order against 0 to 100 per cent."""
    w = Window.partitionBy("series_id").orderBy(F.desc("value"), "ts")
    n = F.count("*").over(Window.partitionBy("series_id"))
    return df.select("series_id", "ts", "value", ((F.row_number().over(w) - 1) / (n - 1) * 100).alias("exceedance"))


def monthly_climatology(df: DataFrame) -> DataFrame:
    return df.groupBy("series_id", F.month("ts").alias("month")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.avg((F.col("value") == 0).cast("double")).alias("zero_share"))


def ecdf(df: DataFrame) -> DataFrame:
    """(series_id, value, p): i / (n + 1) at the last of equal values."""
    w = Window.partitionBy("series_id").orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(Window.partitionBy("series_id"))
    return df.select("series_id", "value", (F.count("*").over(w) / (n + 1)).alias("p")).distinct()


def autocorrelation(df: DataFrame, lags: list[int]) -> DataFrame:
    """(series_id, lag, r): correlation of each series with itself some steps before."""
    w = Window.partitionBy("series_id").orderBy("ts")
    d = df.select("series_id", "value", *(F.lag("value", k).over(w).alias(f"l{k}") for k in lags))
    wide = d.groupBy("series_id").agg(*(correlation("value", f"l{k}").alias(f"l{k}") for k in lags))
    return wide.select("series_id", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"l{k}").alias("r")) for k in lags))).alias("x")).select("series_id", "x.lag", "x.r")


def aggregate_statistics(df: DataFrame, steps: list[int]) -> DataFrame:
    """(series_id, step, mean, variance, dry_share) of sums over blocks of each number of steps."""
    w = Window.partitionBy("series_id").orderBy("ts")
    d = df.withColumn("pos", F.row_number().over(w) - 1).withColumn("step", F.explode(F.array(*map(F.lit, steps))))
    sums = d.groupBy("series_id", "step", F.expr("pos div step").alias("b")).agg(F.sum("value").alias("v"), F.count("*").alias("k")).where("k = step")
    return sums.groupBy("series_id", "step").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("variance"), F.avg((F.col("v") == 0).cast("double")).alias("dry_share"))
