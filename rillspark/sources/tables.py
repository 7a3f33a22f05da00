"""Canonical long tables, (series_id, ts, value) and the like, from the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_DAY, LAST_DAY = "1995-01-01", "2001-08-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_calendar(series: DataFrame, ids: DataFrame, first: str, last: str, step: str = "1 DAY") -> DataFrame:
    """series over every step from first to last for each of ids; steps without a value hold 0."""
    grid = ids.select("series_id", F.explode(F.expr(f"sequence(TIMESTAMP_NTZ'{first}', TIMESTAMP_NTZ'{last}', INTERVAL {step})")).alias("ts"))
    return grid.join(series, ["series_id", "ts"], "left").select("series_id", "ts", F.coalesce("value", F.lit(0.0)).alias("value"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series of five regions: the sum of order prices, zero on days without orders."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    place = nation.join(F.broadcast(region), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", "r_name")  # 25 rows
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(place), F.expr("c_nationkey = n_nationkey"))
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice").join(customer, F.expr("o_custkey = c_custkey"))
    sums = orders.groupBy(F.col("r_name").alias("series_id"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return with_calendar(sums, region.select(F.col("r_name").alias("series_id")), FIRST_DAY, LAST_DAY)


def yearly_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, year, value): the largest order of each nation and year."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("station"))
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nation), F.expr("c_nationkey = n_nationkey"))
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice").join(customer, F.expr("o_custkey = c_custkey"))
    return orders.groupBy("station", F.year("o_orderdate").alias("year")).agg(F.max("o_totalprice").alias("value"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series of the event types: sums of value, zero in hours without events."""
    events = read(spark, sf_dir, "events").select("event_type", "ts", "value")
    sums = events.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.round(F.sum("value"), 4).alias("value"))
    return with_calendar(sums, events.select(F.col("event_type").alias("series_id")).distinct(), "2024-01-01", "2024-01-30 23:00:00", "1 HOUR")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, x, y, value) from suppliers, on a grid by key."""
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS station", "CAST(s_suppkey * 37 % 101 AS DOUBLE) AS x", "CAST(s_suppkey * 53 % 97 AS DOUBLE) AS y", "s_acctbal AS value")


def cells(spark: SparkSession, n: int = 10) -> DataFrame:
    """(cell, x, y): an n x n grid over the stations' square."""
    return spark.range(n * n).selectExpr("id AS cell", f"id % {n} * 10.0D + 0.5D AS x", f"id div {n} * 10.0D + 0.5D AS y")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sim, cell, depth): an ensemble of seven simulations over 200 cells from line items; shallow cells are dry (null)."""
    items = read(spark, sf_dir, "lineitem").selectExpr("CAST(l_linenumber AS INT) AS sim", "CAST(l_partkey % 200 AS INT) AS cell", "l_quantity")
    return items.groupBy("sim", "cell").agg(F.round(F.avg("l_quantity") / 10, 4).alias("d")).selectExpr("sim", "cell", "IF(d >= 2.2, d, NULL) AS depth")


def soils(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pixel, depth, sand, silt, clay) percentages from orders, three depths a pixel; 255 marks no data."""
    o = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_orderkey * 7 % 101 AS INT) AS a", "CAST(o_custkey * 13 % 101 AS INT) AS b", "o_orderkey % 50 = 0 AS gone")
    o = o.selectExpr("o_orderkey", "gone", "least(a, b) AS sand", "abs(a - b) AS silt", "100 - greatest(a, b) AS clay")
    return o.selectExpr("o_orderkey div 3 AS pixel", "CAST(o_orderkey % 3 AS INT) AS depth", "IF(gone, 255, sand) AS sand", "IF(gone, 255, silt) AS silt", "IF(gone, 255, clay) AS clay")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, ts, obs, sim): two event types side by side; null where obs is zero."""
    h = hourly(spark, sf_dir).groupBy("ts").agg(F.max(F.when(F.col("series_id") == "click", F.col("value"))).alias("o"), F.max(F.when(F.col("series_id") == "view", F.col("value"))).alias("sim"))
    return h.selectExpr("'click' AS series_id", "ts", "nullif(o, 0) AS obs", "sim")


# The same tables in DuckDB SQL, as bodies of WITH; the oracles build on them.
SQL_DAILY = """
cal AS (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 1 DAY)) AS ts),
dsum AS (SELECT r_name AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
series AS (SELECT r_name AS series_id, cal.ts, coalesce(v, 0) AS value, row_number() OVER (PARTITION BY r_name ORDER BY cal.ts) - 1 AS pos FROM region CROSS JOIN cal LEFT JOIN dsum ON dsum.series_id = r_name AND dsum.ts = cal.ts)"""
SQL_NATION = """
yearly AS (SELECT n_name AS station, year(o_orderdate) AS year, max(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
SQL_HOURLY = """
hcal AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS ts),
hsum AS (SELECT event_type AS series_id, date_trunc('hour', ts)::TIMESTAMP AS ts, round(sum(value), 4) AS v FROM events GROUP BY ALL),
series AS (SELECT i.series_id, hcal.ts, coalesce(v, 0) AS value, row_number() OVER (PARTITION BY i.series_id ORDER BY hcal.ts) - 1 AS pos FROM (SELECT DISTINCT event_type AS series_id FROM events) i CROSS JOIN hcal LEFT JOIN hsum ON hsum.series_id = i.series_id AND hsum.ts = hcal.ts)"""
SQL_STATIONS = """
stations AS (SELECT s_suppkey AS station, (s_suppkey * 37 % 101)::DOUBLE AS x, (s_suppkey * 53 % 97)::DOUBLE AS y, s_acctbal AS value FROM supplier),
cells AS (SELECT i AS cell, i % 10 * 10.0::DOUBLE + 0.5::DOUBLE AS x, i // 10 * 10.0::DOUBLE + 0.5::DOUBLE AS y FROM range(100) t(i))"""
SQL_RASTER = """
rag AS (SELECT l_linenumber::INT AS sim, (l_partkey % 200)::INT AS cell, round(avg(l_quantity) / 10, 4) AS d FROM lineitem GROUP BY ALL),
raster AS (SELECT sim, cell, CASE WHEN d >= 2.2 THEN d END AS depth FROM rag)"""
SQL_SOILS = """
so AS (SELECT o_orderkey AS k, (o_orderkey * 7 % 101)::INT AS a, (o_custkey * 13 % 101)::INT AS b, o_orderkey % 50 = 0 AS gone FROM orders),
soils AS (SELECT k // 3 AS pixel, (k % 3)::INT AS depth, CASE WHEN gone THEN 255 ELSE least(a, b) END AS sand, CASE WHEN gone THEN 255 ELSE abs(a - b) END AS silt, CASE WHEN gone THEN 255 ELSE 100 - greatest(a, b) END AS clay FROM so)"""
SQL_PAIRS = SQL_HOURLY + """,
pairs AS (SELECT ts, nullif(max(value) FILTER (series_id = 'click'), 0) AS obs, max(value) FILTER (series_id = 'view') AS sim FROM series GROUP BY ts)"""
