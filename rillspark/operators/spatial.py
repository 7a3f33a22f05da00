"""Interpolation and nearest neighbours of points.

The smaller side (stations, design points) is broadcast only if it is within a stated number of rows; beyond it the
join is dealt over blocks of that side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of one side that are broadcast; a larger side is dealt into that many rows at a time.
SMALL = 100_000


def against_all(left: DataFrame, right: DataFrame, small: int = SMALL) -> DataFrame:
    """Every row of left beside every row of right: right is cut into blocks by hash, and left meets block by block, so
    no task holds more than a block of right. Used where each query needs all points by definition."""
    blocks = -(-right.count() // small) or 1
    if blocks == 1:
        return left.join(F.broadcast(right.hint("broadcast")))
    r = right.withColumn("_block", F.pmod(F.xxhash64(*right.columns), F.lit(blocks).cast("long")))
    return left.withColumn("_block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))).join(r, "_block").drop("_block")


def _d2() -> Column:
    return F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2)


def idw(cells: DataFrame, stations: DataFrame, power: float = 2.0) -> DataFrame:
    """(cell, value): inverse-distance mean of all stations; on a station its own value (the first one's)."""
    s = stations.selectExpr("station", "x AS sx", "y AS sy", "value").where("value IS NOT NULL")
    d = against_all(cells, s).withColumn("d2", _d2())
    w = F.when(F.col("d2") > 0, F.pow("d2", -power / 2))
    out = d.groupBy("cell").agg(F.sum(w * F.col("value")).alias("a"), F.sum(w).alias("b"), F.min_by("value", F.when(F.col("d2") == 0, F.col("station"))).alias("hit"), F.count(F.when(F.col("d2") == 0, 1)).alias("hits"))
    return out.select("cell", F.when(F.col("hits") > 0, F.col("hit")).otherwise(F.try_divide("a", "b")).alias("value"))


def idw_series(cells: DataFrame, stations: DataFrame, series: DataFrame, power: float = 2.0) -> DataFrame:
    """(cell, ts, value): the same weights for every date of (station, ts, value)."""
    s = stations.selectExpr("station", "x AS sx", "y AS sy")
    w = against_all(cells, s).select("cell", "station", F.pow(F.greatest(_d2(), F.lit(1e-12)), -power / 2).alias("w"))
    return series.join(w, "station").groupBy("cell", "ts").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def idw_left_out(stations: DataFrame, power: float = 2.0) -> DataFrame:
    """(station, value, predicted): each station from all others."""
    q = stations.selectExpr("station AS cell", "x", "y", "value AS own")
    d = against_all(q, stations.selectExpr("station", "x AS sx", "y AS sy", "value")).where("cell <> station")
    w = F.pow(F.greatest(_d2(), F.lit(1e-12)), -power / 2)
    return d.groupBy(F.col("cell").alias("station")).agg(F.first("own").alias("value"), (F.sum(w * F.col("value")) / F.sum(w)).alias("predicted"))


def nearest(queries: DataFrame, points: DataFrame, k: int = 1) -> DataFrame:
    """(cell, station, distance, place): the k nearest points of each query, smaller key on ties. Candidates shrink to k
    before any shuffle of pairs, by a bounded aggregate."""
    d = against_all(queries, points.selectExpr("station", "x AS sx", "y AS sy")).select("cell", F.struct(F.sqrt(_d2()).alias("distance"), "station").alias("c"))
    w = Window.partitionBy("cell").orderBy("c")
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("cell", "c.station", "c.distance", F.col("place").cast("long"))


def knn_weights(queries: DataFrame, points: DataFrame, k: int = 3) -> DataFrame:
    """(cell, station, weight): weights 1 / distance of the k nearest, summing to one."""
    n = nearest(queries, points, k).withColumn("w", 1 / F.greatest("distance", F.lit(1e-12)))
    return n.select("cell", "station", (F.col("w") / F.sum("w").over(Window.partitionBy("cell"))).alias("weight"))


def rbf_weights(queries: DataFrame, points: DataFrame, sigma: float) -> DataFrame:
    """(cell, station, weight): Gaussian weights of all points, summing to one; shifted by the largest exponent."""
    d = against_all(queries, points.selectExpr("station", "x AS sx", "y AS sy")).withColumn("e", -_d2() / (2 * sigma * sigma))
    w = Window.partitionBy("cell")
    d = d.withColumn("v", F.exp(F.col("e") - F.max("e").over(w)))
    return d.select("cell", "station", (F.col("v") / F.sum("v").over(w)).alias("weight"))


def voronoi_weights(population: DataFrame, points: DataFrame) -> DataFrame:
    """(station, weight): members of the population nearest to each point, points without any included."""
    n = nearest(population, points, 1).groupBy("station").agg(F.count("*").alias("k"))
    return points.select("station").join(n, "station", "left").select("station", F.coalesce("k", F.lit(0)).cast("long").alias("weight"))
