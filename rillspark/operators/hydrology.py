"""Design storms and runoff: IDF curves, hyetographs, curve numbers, routing parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def idf_table(p24: DataFrame, durations: list[float], exponent: float = 1 - 0.28) -> DataFrame:
    """(key, period, duration, depth, intensity): depth p24 (d / 24)^exponent of each duration in hours."""
    d = p24.withColumn("duration", F.explode(F.array(*[F.lit(float(x)) for x in durations]))).withColumn("depth", F.col("p24") * F.pow(F.col("duration") / 24, exponent))
    return d.withColumn("intensity", F.col("depth") / F.col("duration"))


def alternating_blocks(depths: DataFrame, key: str) -> DataFrame:
    """(key, slot, block): increments of cumulative depth by duration, the largest in the middle, then right and left in
    turn; slots count from 1."""
    w = Window.partitionBy(key).orderBy("duration")
    inc = depths.withColumn("inc", F.col("depth") - F.coalesce(F.lag("depth").over(w), F.lit(0.0)))
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("inc"), "duration"))
    n = F.count("*").over(Window.partitionBy(key))
    d = inc.withColumn("r", r).withColumn("n", n)
    # rank 1 in the middle; even ranks go right of it, odd ones left, while both sides have room
    mid = F.expr("(n + 1) div 2")
    slot = F.when(F.col("r") % 2 == 0, mid + F.expr("r div 2")).otherwise(mid - F.expr("r div 2"))
    return d.select(key, slot.cast("long").alias("slot"), F.col("inc").alias("block"))


def scs_runoff(rain: DataFrame, cn: float | str, key: str = "series_id") -> DataFrame:
    """(key, ts, rain, runoff): increments of the curve-number runoff of cumulative rain; Ia = 0.2 S."""
    s = 25400 / (F.col(cn) if isinstance(cn, str) else F.lit(float(cn))) - 254
    w = Window.partitionBy(key).orderBy("ts")
    d = rain.withColumn("s", s).withColumn("p", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("q", F.when(F.col("p") > 0.2 * F.col("s"), F.pow(F.col("p") - 0.2 * F.col("s"), 2) / (F.col("p") + 0.8 * F.col("s"))).otherwise(0.0))
    return d.select(key, "ts", F.col("value").alias("rain"), (F.col("q") - F.coalesce(F.lag("q").over(w), F.lit(0.0))).alias("runoff"))


def unit_hydrograph(runoff: DataFrame, ordinates: list[float], key: str = "series_id", value: str = "runoff") -> DataFrame:
    """(key, pos, flow): runoff spread over the following steps; every row gives as many rows as ordinates, and equal
    positions are summed, so the convolution is one aggregation."""
    w = Window.partitionBy(key).orderBy("ts")
    d = runoff.select(key, (F.row_number().over(w) - 1).alias("i"), F.col(value).alias("v"))
    d = d.select(key, "i", "v", F.posexplode(F.array(*map(F.lit, ordinates))).alias("k", "u"))
    return d.groupBy(key, (F.col("i") + F.col("k")).cast("long").alias("pos")).agg(F.sum(F.col("v") * F.col("u")).alias("flow"))


def clark(length: Column, slope: Column) -> tuple[Column, Column]:
    """Kirpich time of concentration in minutes, and storage 0.6 of it."""
    tc = 0.0195 * F.pow(length, 0.77) * F.pow(slope, -0.385)
    return tc, 0.6 * tc


def muskingum(length: Column, velocity: Column) -> Column:
    return F.round(length / velocity / 3600, 3)


def normal_depth(q: Column, width: Column, slope: Column, n: Column, rounds: int = 60) -> Column:
    """Depth of uniform flow in a wide rectangular channel, by bisection inside one expression; below 1 m3/s: 0.05 m."""
    step = lambda a, _: F.when(q > width * F.pow((a["lo"] + a["hi"]) / 2 * width / (width + a["lo"] + a["hi"]), 2 / 3) * (a["lo"] + a["hi"]) / 2 * F.sqrt(slope) / n, F.struct(((a["lo"] + a["hi"]) / 2).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), ((a["lo"] + a["hi"]) / 2).alias("hi")))
    depth = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(0.0).alias("lo"), F.lit(1000.0).alias("hi")), step, lambda a: (a["lo"] + a["hi"]) / 2)
    return F.when(q < 1, F.lit(0.05)).otherwise(depth)


def idf_change(control: DataFrame, future: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ratio): depth of the future over that of the control of the same keys; null where the control is 0."""
    return future.select(*keys, F.col("depth").alias("f")).join(control.select(*keys, F.col("depth").alias("c")), keys).select(*keys, F.try_divide("f", "c").alias("ratio"))


def linear_reservoir(inflow: DataFrame, share: float, key: str = "series_id") -> DataFrame:
    """(key, ts, flow): outflow Q = share I + (1 - share) Q', Q' that of the step before, from an empty store.

    A step reads only as many steps back as have a weight above 1e-18, so a long series needs no fold from its start.
    share lies above 0 and at most at 1; null inflow counts as 0."""
    back = 0
    while (1 - share) ** back > 1e-18:
        back += 1
    w = Window.partitionBy(key).orderBy("ts").rowsBetween(-back, 0)
    keep = F.lit(1.0 - share)
    flow = F.aggregate(F.collect_list(F.coalesce("value", F.lit(0.0))).over(w), F.lit(0.0), lambda q, x: q * keep + x * share)
    return inflow.select(key, "ts", flow.alias("flow"))


def rating_curve(points: DataFrame, queries: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, q, stage) for each (key, q) of queries: the mean stage of the k points nearest in log1p(q), scaled to the
    points' range, weighted by 1 / distance; points (key, q, stage) of equal q count as one, of mean stage.

    The k nearest of a sorted list lie within k ranks of the query, so each query meets 2 k points by an equi join."""
    p = points.where("q IS NOT NULL AND stage IS NOT NULL").groupBy(key, "q").agg(F.avg("stage").alias("stage"))
    ranked = p.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("q")))
    span = p.groupBy(key).agg((F.max(F.log1p("q")) - F.min(F.log1p("q"))).alias("span"))
    # how many points lie at or below each query: one sorted pass over both
    both = p.select(key, "q", F.lit(1).alias("is_point")).unionByName(queries.select(key, "q", F.lit(0).alias("is_point")))
    below = F.sum("is_point").over(Window.partitionBy(key).orderBy("q"))
    asked = both.withColumn("below", below).where("is_point = 0").select(key, F.col("q").alias("at"), "below").distinct()
    near = asked.withColumn("place", F.explode(F.sequence(F.col("below") - (k - 1), F.col("below") + k))).withColumn("place", F.col("place").cast("int"))
    d = near.join(ranked, [key, "place"]).join(span, key).withColumn("distance", F.coalesce(F.try_divide(F.abs(F.log1p("at") - F.log1p("q")), "span"), F.lit(0.0)))
    best = d.withColumn("r", F.row_number().over(Window.partitionBy(key, "at").orderBy("distance", "q"))).where(F.col("r") <= k)
    w = 1 / F.greatest("distance", F.lit(1e-12))
    return best.groupBy(key, F.col("at").alias("q")).agg((F.sum(w * F.col("stage")) / F.sum(w)).alias("stage"))
