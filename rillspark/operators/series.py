"""Preparation of series: common periods, standardising, complete blocks and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def common_period(df: DataFrame) -> DataFrame:
    """Rows of (series_id, ts, value) inside the period that all series with values cover; null values are no cover.

    No rows if the periods do not overlap."""
    spans = df.where("value IS NOT NULL").groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    span = spans.agg(F.max("a").alias("first"), F.min("b").alias("last"))
    return df.join(F.broadcast(span), F.col("ts").between(F.col("first"), F.col("last"))).select("series_id", "ts", "value")  # one row


def standardised_mean(df: DataFrame) -> DataFrame:
    """(ts, z, n): the mean over series of the values less their series' mean, over its sample deviation.

    Series of one value or without spread are left out; nulls do not count."""
    stats = df.groupBy("series_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).where("s > 0")
    z = df.where("value IS NOT NULL").join(stats, "series_id").select("ts", ((F.col("value") - F.col("m")) / F.col("s")).alias("z"))
    return z.groupBy("ts").agg(F.avg("z").alias("z"), F.count("z").alias("n"))


def complete_maxima(df: DataFrame, least: int) -> DataFrame:
    """(series_id, year, value): largest value of each year that holds at least that many values."""
    return df.groupBy("series_id", F.year("ts").alias("year")).agg(F.max("value").alias("value"), F.count("value").alias("n")).where(F.col("n") >= least).drop("n")


def last_of_each(df: DataFrame, order: str) -> DataFrame:
    """One row for each (series_id, ts): that of the greatest order."""
    last = df.groupBy("series_id", "ts").agg(F.max_by("value", order).alias("value"))
    return last


def monthly_mean(df: DataFrame) -> DataFrame:
    """(series_id, month, value): mean of each calendar month."""
    return df.groupBy("series_id", F.trunc("ts", "month").alias("month")).agg(F.avg("value").alias("value"))


def carried_forward(df: DataFrame, steps: DataFrame) -> DataFrame:
    """(series_id, ts, value): at every step (series_id, ts) the last value that is not null so far; null before the first."""
    both = steps.select("series_id", "ts", F.lit(None).cast("double").alias("value"), F.lit(True).alias("step")).unionByName(df.select("series_id", "ts", "value", F.lit(False).alias("step")))
    so_far = Window.partitionBy("series_id").orderBy("ts", "step").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("value", F.last("value", ignorenulls=True).over(so_far)).where("step").select("series_id", "ts", "value")


def variation(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, cv): deviation over mean of the values that are not null; null where the mean is 0."""
    return df.groupBy(key).agg((F.stddev_pop(value) / F.nullif(F.avg(value), F.lit(0.0))).alias("cv"))


def well_covered(df: DataFrame, share: float) -> DataFrame:
    """(series_id, n, total): series that hold a value on at least share of all distinct times of the table."""
    total = df.agg(F.count_distinct("ts").alias("total"))
    n = df.where("value IS NOT NULL").groupBy("series_id").agg(F.count_distinct("ts").alias("n"))
    return n.join(F.broadcast(total), F.col("n") >= share * F.col("total"))  # one row


def standardised_maxima(df: DataFrame) -> DataFrame:
    """(series_id, year, z, back): each year's largest z over all series, z by the population deviation, and that z in the
    units of each series. Series without spread are left out."""
    stats = df.groupBy("series_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).where("s > 0")
    z = df.where("value IS NOT NULL").join(stats, "series_id").groupBy(F.year("ts").alias("year")).agg(F.max((F.col("value") - F.col("m")) / F.col("s")).alias("z"))
    return stats.join(F.broadcast(z)).select("series_id", "year", "z", (F.col("m") + F.col("s") * F.col("z")).alias("back"))  # a row for each year


def at_steps(df: DataFrame, steps: DataFrame) -> DataFrame:
    """(series_id, ts, nearest, linear) at every step (series_id, ts): the value nearest in time, the earlier one on ties,
    and the line between the values before and after; outside them nearest is the end value, linear is null. Null
    values do not count; a time with several values has their mean."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    known = df.where("value IS NOT NULL").groupBy("series_id", "ts").agg(F.avg("value").alias("v")).withColumn("known", F.struct(at.alias("at"), "v")).drop("v")
    both = known.withColumn("step", F.lit(False)).unionByName(steps.select("series_id", "ts", F.lit(None).cast(known.schema["known"].dataType).alias("known"), F.lit(True).alias("step")))
    w = Window.partitionBy("series_id").orderBy("ts")
    a = F.last("known", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    b = F.first("known", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    d = both.withColumns({"a": a, "b": b, "at": at}).where("step")
    before, after = F.col("at") - F.col("a.at"), F.col("b.at") - F.col("at")
    nearest = F.when(F.col("b").isNull() | (before <= after), F.col("a.v")).otherwise(F.col("b.v"))
    span = before + after
    linear = F.when(span == 0, F.col("a.v")).otherwise(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (before / span))
    return d.select("series_id", "ts", nearest.alias("nearest"), linear.alias("linear"))


def type_medians(df: DataFrame, kind: str, step: str, value: str = "value") -> DataFrame:
    """(kind, step, median): the median value of each type at each step; nulls do not count."""
    return df.groupBy(kind, step).agg(F.median(value).alias("median"))


def two_sample_t(df: DataFrame, flag: str, value: str) -> DataFrame:
    """(n_a, n_b, mean_a, mean_b, t, dof) of the values where flag is true (a) and false (b), with pooled variance. t is
    null without spread or with fewer than three values; null flags and values do not count."""
    a, b = F.when(F.col(flag), F.col(value)), F.when(~F.col(flag), F.col(value))
    d = df.agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.var_pop(a).alias("v_a"), F.var_pop(b).alias("v_b"))
    dof = F.col("n_a") + F.col("n_b") - 2
    pooled = F.try_divide(F.col("n_a") * F.col("v_a") + F.col("n_b") * F.col("v_b"), dof)
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("n_a")) + F.try_divide(F.lit(1.0), F.col("n_b"))))
    return d.select("n_a", "n_b", "mean_a", "mean_b", F.when(dof > 0, F.try_divide(F.col("mean_a") - F.col("mean_b"), error)).alias("t"), dof.alias("dof"))


def quantile_errors(observed: DataFrame, synthetic: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(variable, p, observed, synthetic, error): quantiles of each column in two tables and synthetic less observed."""

    def quantiles(df: DataFrame, name: str) -> DataFrame:
        p = F.array(*map(F.lit, shares))
        row = df.agg(*(F.percentile(c, shares).alias(c) for c in columns))
        return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.arrays_zip(p.alias("p"), F.col(c).alias("q")).alias("x")) for c in columns))).alias("r")).select("r.variable", F.explode("r.x").alias("x")).select("variable", F.col("x.p").alias("p"), F.col("x.q").alias(name))

    return quantiles(observed, "observed").join(quantiles(synthetic, "synthetic"), ["variable", "p"]).withColumn("error", F.col("synthetic") - F.col("observed"))
