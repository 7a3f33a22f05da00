"""The engine's operators as named queries over the driver's tables, and their DuckDB SQL.

Both sides round computed doubles, because sums in another order differ in their last bits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..operators import bias, copulas, design, ensemble, events, extremes, fields, hydrology, joint, regional, series, skill, spatial
from ..sources import parsers
from ..sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WET, FLOOD, PEAK = 150000.0, 200000.0, 300000.0


def rounded(df: DataFrame, digits: int = 4, **own: int) -> DataFrame:
    return df.select(*(F.round(c, own.get(c, digits)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def query(name: str, sql: str | None = None, *tables: str):
    """Registers a query; sql may use the named WITH bodies, and its own CTEs start with a comma."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            s = sql.strip()
            SQL[name] = ("WITH " + ("RECURSIVE " if "/*recursive*/" in s else "") + ",".join(tables) + (s if s.startswith(",") else "\n" + s)) if tables else s
        return f

    return add


D, N, H, S, R, O, P = t.SQL_DAILY, t.SQL_NATION, t.SQL_HOURLY, t.SQL_STATIONS, t.SQL_RASTER, t.SQL_SOILS, t.SQL_PAIRS
ANNUAL = """
annual AS (SELECT series_id, make_date(year(ts), 12, 31) AS block_end, max(value) AS value FROM series GROUP BY series_id, year(ts))"""


def annual(spark: SparkSession, d: str) -> DataFrame:
    return extremes.block_maxima(t.daily(spark, d))


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("block_end", F.col("block_end").cast("timestamp_ntz"))


# blocks and plotting positions


@query("block_maxima_year", "SELECT series_id, block_end::TIMESTAMP AS block_end, value FROM annual", D, ANNUAL)
def _(s, d):
    return stamped(annual(s, d))


@query("block_maxima_quarter", "SELECT series_id, (date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::TIMESTAMP AS block_end, max(value) AS value FROM series GROUP BY ALL", D)
def _(s, d):
    return stamped(extremes.block_maxima(t.daily(s, d), "quarter"))


@query("block_maxima_month", "SELECT series_id, last_day(ts)::TIMESTAMP AS block_end, max(value) AS value FROM series GROUP BY ALL", D)
def _(s, d):
    return stamped(extremes.block_maxima(t.daily(s, d), "month"))


@query("date_of_annual_max", "SELECT series_id, year(ts)::INT AS year, arg_min(ts, (-value, ts)) AS ts, max(value) AS value FROM series GROUP BY ALL", D)
def _(s, d):
    return extremes.date_of_maximum(t.daily(s, d))


@query("month_histogram", "SELECT month(ts)::INT AS month, count(*) AS n FROM (SELECT series_id, arg_min(ts, (-value, ts)) AS ts FROM series GROUP BY series_id, year(ts)) GROUP BY ALL", D)
def _(s, d):
    return extremes.date_of_maximum(t.daily(s, d)).groupBy(F.month("ts").alias("month")).agg(F.count("*").alias("n"))


@query(
    "plotting_positions",
    "SELECT series_id, block_end::TIMESTAMP AS block_end, value, i AS rank, round((i - 0.44) / (n + 0.12), 6) AS p, round(1 / (1 - (i - 0.44) / (n + 0.12)), 6) AS return_period, round((i - 0.5) / n, 6) AS qq, round(i / (n + 1), 6) AS pp FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value, block_end) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM annual)",
    D,
    ANNUAL,
)
def _(s, d):
    return stamped(rounded(extremes.plotting_positions(annual(s, d)), 6, value=2))


# L-moments and return levels

LM = """
, rk AS (SELECT {g} AS g, {v} AS v, row_number() OVER (PARTITION BY {g} ORDER BY {v}) - 1 AS j, count(*) OVER (PARTITION BY {g}) AS n FROM {t}),
bb AS (SELECT g, count(*) AS n, avg(v) AS b0, avg(j / nullif(n - 1, 0) * v) AS b1, avg(j * (j - 1) / nullif((n - 1) * (n - 2), 0) * v) AS b2, avg(j * (j - 1) * (j - 2) / nullif((n - 1) * (n - 2) * (n - 3), 0) * v) AS b3 FROM rk GROUP BY g),
lm AS (SELECT g, n, b0 AS l1, 2 * b1 - b0 AS l2, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) AS t3, (20 * b3 - 30 * b2 + 12 * b1 - b0) / (2 * b1 - b0) AS t4, (2 * b1 - b0) / b0 AS t FROM bb)"""
LM_ANNUAL, LM_NATION = LM.format(g="series_id", v="value", t="annual"), LM.format(g="station", v="value", t="yearly")
GEV = """
, kk AS (SELECT *, 7.859 * c + 2.9554 * c * c AS k FROM (SELECT *, 2 / (3 + t3) - ln(2) / ln(3) AS c FROM lm)),
gv AS (SELECT *, l2 * k / ((1 - pow(2, -k)) * gamma(1 + k)) AS sigma FROM kk),
gev AS (SELECT *, l1 - sigma * (1 - gamma(1 + k)) / k AS mu, -k AS xi FROM gv)"""


@query("rfa_gumbel_lmom", LM_ANNUAL + " SELECT g AS series_id, n, round(l1, 4) AS l1, round(l2, 4) AS l2, round(t3, 6) AS t3, round(l1 - 0.5772156649015329 * l2 / ln(2) - l2 / ln(2) * ln(-ln(0.99)), 4) AS level_100 FROM lm", D, ANNUAL)
def rfa_gumbel_lmom(s, d):
    """Annual maxima of each region, their L-moments, and the Gumbel level of 100 years."""
    g = extremes.gumbel_from_lmoments(extremes.lmoments(annual(s, d), "series_id"))
    return rounded(g.select("series_id", "n", "l1", "l2", "t3", dist.gev_level(100, "mu", "sigma", "xi").alias("level_100")), 4, t3=6)


@query("site_lmoment_ratios", LM_NATION + " SELECT g AS station, n, round(l1, 4) AS l1, round(l2, 4) AS l2, round(t, 6) AS t, round(t3, 6) AS t3, round(t4, 6) AS t4 FROM lm", N)
def _(s, d):
    return rounded(extremes.lmoments(t.yearly_by_nation(s, d), "station"), 6, l1=4, l2=4)


@query("gev_lmom", LM_ANNUAL + GEV + " SELECT g AS series_id, round(mu, 2) AS mu, round(sigma, 2) AS sigma, round(xi, 5) AS xi FROM gev", D, ANNUAL)
def _(s, d):
    return rounded(extremes.gev_from_lmoments(extremes.lmoments(annual(s, d), "series_id")).select("series_id", "mu", "sigma", "xi"), 2, xi=5)


@query("return_levels_gev", LM_ANNUAL + GEV + " SELECT g AS series_id, p::DOUBLE AS period, round(mu + sigma / xi * (pow(-ln(1 - 1 / p), -xi) - 1), 1) AS level FROM gev, (VALUES (2), (10), (50), (100)) q(p)", D, ANNUAL)
def _(s, d):
    f = extremes.gev_from_lmoments(extremes.lmoments(annual(s, d), "series_id"))
    return rounded(extremes.return_levels(f, [2, 10, 50, 100], lambda p: dist.gev_level(p, "mu", "sigma", "xi")).select("series_id", "period", "level"), 1)


@query("return_period_of_value", LM_ANNUAL + GEV + " SELECT g AS series_id, round(1 / (1 - exp(-pow(1 + xi * (l1 * 1.2 - mu) / sigma, -1 / xi))), 2) AS return_period FROM gev", D, ANNUAL)
def _(s, d):
    f = extremes.gev_from_lmoments(extremes.lmoments(annual(s, d), "series_id"))
    return f.select("series_id", F.round(dist.gev_period(F.col("l1") * 1.2, "mu", "sigma", "xi"), 2).alias("return_period"))


EXC = """
, ex AS (SELECT series_id, value - 200000 AS v FROM series WHERE value > 200000)""" + LM.format(g="series_id", v="v", t="ex")


@query("gpd_lmom", EXC + " SELECT g AS series_id, n, round((l1 / l2 - 1) * l1, 3) AS scale, round(2 - l1 / l2, 6) AS shape FROM lm", D)
def _(s, d):
    e = t.daily(s, d).where(F.col("value") > FLOOD).select("series_id", (F.col("value") - FLOOD).alias("value"))
    return rounded(extremes.gpd_from_lmoments(extremes.lmoments(e, "series_id")).select("series_id", "n", "scale", "shape"), 3, shape=6)


@query("return_levels_gpd", EXC + " SELECT g AS series_id, p::DOUBLE AS period, round(200000 + (l1 / l2 - 1) * l1 / (2 - l1 / l2) * (pow(n / 6.6 * p, 2 - l1 / l2) - 1), 2) AS level FROM lm, (VALUES (5), (20), (100)) q(p)", D)
def _(s, d):
    e = t.daily(s, d).where(F.col("value") > FLOOD).select("series_id", (F.col("value") - FLOOD).alias("value"))
    f = extremes.gpd_from_lmoments(extremes.lmoments(e, "series_id")).withColumn("rate", F.col("n") / 6.6)
    return rounded(extremes.return_levels(f, [5, 20, 100], lambda p: dist.gpd_level(p, "scale", "shape", FLOOD, "rate")).select("series_id", "period", "level"), 2)


@query("threshold_stability", ", q AS (SELECT series_id, p, u FROM (SELECT series_id, [0.5, 0.7, 0.9, 0.95] AS ps, quantile_cont(value, [0.5, 0.7, 0.9, 0.95]) AS us FROM series WHERE value > 0 GROUP BY ALL), LATERAL (SELECT unnest(ps) AS p, unnest(us) AS u)) SELECT q.series_id, q.p::DOUBLE AS p, round(u, 3) AS threshold, count(*) AS n_exceed, round(avg(value - u), 4) AS mean_excess FROM q JOIN series s ON s.series_id = q.series_id AND value > u GROUP BY ALL", D)
def _(s, d):
    x = t.daily(s, d)
    ps = [0.5, 0.7, 0.9, 0.95]
    q = x.where("value > 0").groupBy("series_id").agg(F.percentile("value", F.array(*map(F.lit, ps))).alias("u")).select("series_id", F.explode(F.arrays_zip(F.array(*map(F.lit, ps)).alias("p"), "u")).alias("z")).select("series_id", "z.p", "z.u")
    e = x.join(q, "series_id").where("value > u")
    return rounded(e.groupBy("series_id", "p", F.col("u").alias("threshold")).agg(F.count("*").alias("n_exceed"), F.avg(F.col("value") - F.col("u")).alias("mean_excess")), 3, mean_excess=4)


# events

ISLE = """
, w AS (SELECT *, sum(value) OVER (PARTITION BY series_id ORDER BY pos) AS cum FROM series),
m AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY series_id ORDER BY pos) <= {gap} THEN 0 ELSE 1 END AS fresh FROM w WHERE {cond}),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY pos) AS isle FROM m)"""


@query(
    "wet_spells",
    ISLE.format(gap=2, cond="value > 150000")
    + ", e AS (SELECT series_id, isle, min(ts) AS date_start, max(ts) AS date_end, min(pos) AS a, max(pos) AS b, max(value) AS peak, avg(value) AS mean_intensity FROM i GROUP BY ALL) SELECT e.series_id, date_start, date_end, peak, round(sum(s.value), 2) AS total, b - a + 1 AS duration, round(mean_intensity, 6) AS mean_intensity FROM e JOIN series s ON s.series_id = e.series_id AND s.pos BETWEEN a AND b GROUP BY ALL HAVING b - a + 1 >= 2",
    D,
)
def _(s, d):
    return rounded(events.wet_spells(t.daily(s, d), WET, 1, 2), 2, mean_intensity=6)


@query("dry_spells", ISLE.format(gap=1, cond="value <= 150000") + " SELECT series_id, duration, count(*) AS spells FROM (SELECT series_id, isle, count(*) AS duration FROM i GROUP BY ALL) GROUP BY ALL", D)
def _(s, d):
    return events.dry_spells(t.daily(s, d), WET)


MARKS = """
, k AS (SELECT *, lag(value) OVER w AS prv, lead(value) OVER w AS nxt, count(*) OVER (PARTITION BY series_id) AS n FROM series WINDOW w AS (PARTITION BY series_id ORDER BY pos))"""


@query(
    "discharge_events",
    MARKS
    + """, up AS (SELECT series_id, pos FROM k WHERE nxt > value AND value <= 200000 AND nxt > 200000),
dn AS (SELECT series_id, pos FROM k WHERE value < prv AND prv >= 200000 AND value < 200000),
lo AS (SELECT series_id, pos FROM k WHERE prv > value AND nxt > value),
pr AS (SELECT u.series_id, u.pos AS ref, (SELECT min(pos) FROM dn WHERE dn.series_id = u.series_id AND dn.pos > u.pos) AS e FROM up u),
b AS (SELECT p.series_id, ref, coalesce((SELECT max(pos) FROM lo WHERE lo.series_id = p.series_id AND lo.pos <= ref), greatest(0, ref - 1)) AS a, coalesce((SELECT min(pos) FROM lo WHERE lo.series_id = p.series_id AND lo.pos >= e), least(e + 1, (SELECT max(pos) FROM series))) AS z FROM pr p WHERE e IS NOT NULL)
SELECT b.series_id, min(ts) AS date_start, max(ts) AS date_end, max(value) AS peak, round(avg(value), 6) AS mean, max(z - a) AS duration, round(sum(value) * 86400, 0) AS volume, arg_min(ts, (-value, pos)) AS date_peak FROM b JOIN series s ON s.series_id = b.series_id AND s.pos BETWEEN a AND z GROUP BY b.series_id, ref HAVING max(value) >= 300000""",
    D,
)
def _(s, d):
    return rounded(events.discharge_events(t.daily(s, d), FLOOD, PEAK), 2, mean=6, volume=0)


@query(
    "discharge_events_peak_apex",
    MARKS
    + """, lo AS (SELECT series_id, pos FROM k WHERE prv > value AND nxt > value), hi AS (SELECT series_id, pos FROM k WHERE prv < value AND nxt < value),
m AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY series_id ORDER BY pos) <= 1 THEN 0 ELSE 1 END AS fresh FROM k WHERE value >= 200000),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY pos) AS isle FROM m),
r AS (SELECT series_id, min(pos) AS a, max(pos) AS b, max(value) AS peak FROM i GROUP BY series_id, isle),
f AS (SELECT r.series_id, coalesce((SELECT max(pos) FROM lo WHERE lo.series_id = r.series_id AND lo.pos <= a), a) AS start_pos, coalesce((SELECT max(pos) FROM hi WHERE hi.series_id = r.series_id AND hi.pos <= b + 1), b) AS end_pos, peak FROM r)
SELECT * FROM f WHERE peak >= 300000 AND end_pos >= start_pos""",
    D,
)
def _(s, d):
    return events.flood_events(t.daily(s, d), FLOOD, PEAK)


@query(
    "pot_rain_events",
    ISLE.format(gap=2, cond="value > 300000")
    + """, pk AS (SELECT series_id, arg_min(pos, (-value, pos)) AS pos FROM i GROUP BY series_id, isle),
pm AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY series_id ORDER BY pos) <= 1 THEN 0 ELSE 1 END AS fresh FROM series WHERE value > 0),
pi AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY pos) AS run FROM pm),
sp AS (SELECT series_id, run, min(ts) AS date_start, max(ts) AS date_end, sum(value) AS total, count(*) AS duration, avg(value) AS mean_intensity FROM pi GROUP BY ALL)
SELECT pk.series_id, pi.ts AS date_peak, pi.value AS peak, date_start, date_end, round(total, 2) AS total, duration, round(mean_intensity, 6) AS mean_intensity FROM pk JOIN pi ON pi.series_id = pk.series_id AND pi.pos = pk.pos JOIN sp ON sp.series_id = pi.series_id AND sp.run = pi.run""",
    D,
)
def _(s, d):
    return rounded(events.pot_rain_events(t.daily(s, d), PEAK, 2), 2, mean_intensity=6)


@query(
    "nday_events",
    """, r AS (SELECT *, CASE WHEN pos >= 2 THEN round(sum(value) OVER x, 6) END AS r, max(value) OVER x AS top, min(ts) OVER x AS a FROM series WINDOW x AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
q AS (SELECT series_id, quantile_cont(r, 0.9) AS u FROM r WHERE r > 0 GROUP BY ALL),
m AS (SELECT r.*, CASE WHEN pos - lag(pos) OVER (PARTITION BY r.series_id ORDER BY pos) <= 3 THEN 0 ELSE 1 END AS fresh FROM r JOIN q ON q.series_id = r.series_id AND r > u),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY pos) AS isle FROM m)
SELECT series_id, arg_min(a, (-r, pos)) AS date_start, arg_min(ts, (-r, pos)) AS date_end, round(max(r), 2) AS total, arg_min(top, (-r, pos)) AS peak, 3::BIGINT AS duration FROM i GROUP BY series_id, isle""",
    D,
)
def _(s, d):
    return rounded(events.nday_events(t.daily(s, d), 3), 2)


@query(
    "concurrent_events",
    ISLE.format(gap=2, cond="value > 150000 AND series_id = 'ASIA'")
    + ", e AS (SELECT isle AS event_id, min(ts) - INTERVAL 1 DAY AS a, max(ts) + INTERVAL 1 DAY AS b FROM i GROUP BY ALL HAVING max(pos) - min(pos) + 1 >= 4) SELECT event_id::BIGINT AS event_id, series_id, max(value) AS max, round(avg(value), 6) AS mean, round(sum(value), 2) AS total FROM e JOIN series ON ts BETWEEN a AND b GROUP BY ALL",
    D,
)
def _(s, d):
    x = t.daily(s, d)
    hit = events._islands(events.with_pos(x.where("series_id = 'ASIA'")).where(F.col("value") > WET), 2)
    e = hit.groupBy(F.col("island").alias("event_id")).agg(F.min("ts").alias("date_start"), F.max("ts").alias("date_end"), (F.max("pos") - F.min("pos") + 1).alias("k")).where("k >= 4")
    return rounded(events.concurrent_events(e, x), 2, mean=6)


@query(
    "pot_peaks",
    MARKS
    + """, c AS (SELECT series_id, pos, value, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS i FROM k WHERE value >= 250000 AND value >= prv AND value >= nxt),
f(series_id, i, kp, kv, np, nv) AS (/*recursive*/ SELECT series_id, i, pos, value, NULL::BIGINT, NULL::DOUBLE FROM c WHERE i = 1 UNION ALL
 SELECT c.series_id, c.i, CASE WHEN c.pos - kp >= 5 OR c.value > kv THEN c.pos ELSE kp END, CASE WHEN c.pos - kp >= 5 OR c.value > kv THEN c.value ELSE kv END, CASE WHEN c.pos - kp >= 5 THEN kp END, CASE WHEN c.pos - kp >= 5 THEN kv END FROM f JOIN c ON c.series_id = f.series_id AND c.i = f.i + 1)
SELECT series_id, np AS pos, nv AS value FROM f WHERE np IS NOT NULL UNION ALL SELECT series_id, kp, kv FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY i DESC) AS z FROM f) WHERE z = 1""",
    D,
)
def _(s, d):
    return events.pot_peaks(t.daily(s, d), 250000.0, 5)


@query("rolling_sum_n", "SELECT series_id, ts, CASE WHEN pos >= 6 THEN round(sum(value) OVER (PARTITION BY series_id ORDER BY pos ROWS 6 PRECEDING), 3) END AS rolling FROM series", H)
def _(s, d):
    return rounded(events.rolling_sum(t.hourly(s, d), 7), 3)


@query("rolling_max_centered", "SELECT series_id, ts, max(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS rolling FROM series", H)
def _(s, d):
    return events.rolling_max(t.hourly(s, d), 5)


# regional analysis


@query("regional_index_flood", ", m AS (SELECT station, avg(value) AS x FROM yearly GROUP BY ALL) SELECT station, year::INT AS year, value, round(x, 4) AS index_flood, round(value / x, 6) AS normalised FROM yearly JOIN m USING (station)", N)
def _(s, d):
    return rounded(regional.index_flood(t.yearly_by_nation(s, d)), 4, normalised=6)


@query("regional_return_levels", ", m AS (SELECT station, avg(value) AS x FROM yearly GROUP BY ALL), z AS (SELECT 'all' AS r, value / x AS v FROM yearly JOIN m USING (station))" + LM.format(g="r", v="v", t="z") + GEV + " SELECT station, p::DOUBLE AS period, round(x * (mu + sigma / xi * (pow(-ln(1 - 1 / p), -xi) - 1)), 1) AS level FROM gev, m, (VALUES (10), (100)) q(p)", N)
def _(s, d):
    return rounded(regional.regional_levels(t.yearly_by_nation(s, d), [10, 100]), 1)


@query(
    "discordancy",
    LM_NATION
    + """, g1 AS (SELECT * FROM lm WHERE t4 IS NOT NULL),
s1 AS (SELECT count(*) AS ns, avg(t) AS mt, avg(t3) AS m3, avg(t4) AS m4, covar_samp(t, t) AS a, covar_samp(t, t3) AS b, covar_samp(t, t4) AS c, covar_samp(t3, t3) AS e, covar_samp(t3, t4) AS f, covar_samp(t4, t4) AS i FROM g1),
x1 AS (SELECT *, t - mt AS p, t3 - m3 AS q, t4 - m4 AS r FROM g1, s1),
y1 AS (SELECT *, ns / (3 * (ns - 1)) * (p * p * (e * i - f * f) + q * q * (a * i - c * c) + r * r * (a * e - b * b) + 2 * (p * q * (c * f - b * i) + p * r * (b * f - c * e) + q * r * (b * c - a * f))) / (a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c)) AS d FROM x1)
SELECT g AS station, n, round(t, 6) AS t, round(t3, 6) AS t3, round(t4, 6) AS t4, round(d, 5) AS d, d > 3.0 AS discordant FROM y1""",
    N,
)
def _(s, d):
    return rounded(regional.discordancy(t.yearly_by_nation(s, d)), 6, d=5)


@query("weighted_lcv_dispersion", LM_NATION + ", mm AS (SELECT sum(n * t) / sum(n) AS m FROM lm) SELECT round(sqrt(sum(n * pow(t - m, 2)) / sum(n)), 7) AS v FROM lm, mm", N)
def _(s, d):
    return rounded(regional.weighted_dispersion(t.yearly_by_nation(s, d)), 7)


# bias correction


def _roles(s, d):
    h = t.hourly(s, d).where("value > 0")
    return [h.where(F.col("series_id") == k).withColumn("series_id", F.lit("x")) for k in ("click", "view", "purchase")]


@query(
    "delta_precip",
    ", h AS (SELECT series_id, m, avg(v) AS h FROM (SELECT series_id, month(ts) AS m, year(ts) AS y, sum(value) AS v FROM series WHERE year(ts) < 1998 GROUP BY ALL) GROUP BY ALL), f AS (SELECT series_id, m, avg(v) AS f FROM (SELECT series_id, month(ts) AS m, year(ts) AS y, sum(value) AS v FROM series WHERE year(ts) BETWEEN 1998 AND 2000 GROUP BY ALL) GROUP BY ALL) SELECT s.series_id, ts + INTERVAL 3 YEAR AS ts, round(value * (f / nullif(h, 0)), 3) AS value FROM series s JOIN h ON s.series_id = h.series_id AND month(ts) = h.m JOIN f ON s.series_id = f.series_id AND month(ts) = f.m WHERE year(ts) < 1998",
    D,
)
def _(s, d):
    x = t.daily(s, d)
    hist, future = x.where(F.year("ts") < 1998), x.where(F.year("ts").between(1998, 2000))
    return rounded(bias.monthly_delta(hist, hist, future, True, by=("series_id",)), 3)


@query(
    "delta_temperature",
    ", h AS (SELECT series_id, m, avg(v) AS h FROM (SELECT series_id, month(ts) AS m, year(ts) AS y, avg(value) AS v FROM series WHERE year(ts) < 1998 GROUP BY ALL) GROUP BY ALL), f AS (SELECT series_id, m, avg(v) AS f FROM (SELECT series_id, month(ts) AS m, year(ts) AS y, avg(value) AS v FROM series WHERE year(ts) BETWEEN 1998 AND 2000 GROUP BY ALL) GROUP BY ALL) SELECT s.series_id, ts + INTERVAL 3 YEAR AS ts, round(value + f - h, 3) AS value FROM series s JOIN h ON s.series_id = h.series_id AND month(ts) = h.m JOIN f ON s.series_id = f.series_id AND month(ts) = f.m WHERE year(ts) < 1998",
    D,
)
def _(s, d):
    x = t.daily(s, d)
    hist, future = x.where(F.year("ts") < 1998), x.where(F.year("ts").between(1998, 2000))
    return rounded(bias.monthly_delta(hist, hist, future, by=("series_id",)), 3)


QM = """
, o AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM series WHERE series_id = 'click' AND value > 0),
mo AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM series WHERE series_id = 'view' AND value > 0),
sc AS (SELECT ts, value, (SELECT count(*) FROM mo WHERE v <= s.value) / (SELECT count(*) FROM mo) AS p FROM series s WHERE series_id = 'purchase' AND value > 0),
qq AS (SELECT sc.*, a.v + (p * (a.n - 1) - a.i) * (coalesce(a2.v, a.v) - a.v) AS qo, b.v + (p * (b.n - 1) - b.i) * (coalesce(b2.v, b.v) - b.v) AS qm FROM sc JOIN o a ON a.i = floor(p * (a.n - 1)) LEFT JOIN o a2 ON a2.i = a.i + 1 JOIN mo b ON b.i = floor(p * (b.n - 1)) LEFT JOIN mo b2 ON b2.i = b.i + 1)"""


@query("eqm", QM + " SELECT 'x' AS series_id, ts, value, round(p, 6) AS p, round(greatest(value + qo - qm, 0), 4) AS corrected FROM qq", H)
def _(s, d):
    return rounded(bias.quantile_mapping(*_roles(s, d)), 4, p=6)


@query("qdm", QM + " SELECT 'x' AS series_id, ts, value, round(p, 6) AS p, round(greatest(value * (qo / qm), 0), 4) AS corrected FROM qq", H)
def _(s, d):
    return rounded(bias.quantile_mapping(*_roles(s, d), multiplicative=True), 4, p=6)


# skill and quality


@query(
    "skill_scores",
    ", c AS (SELECT * FROM pairs WHERE obs IS NOT NULL AND sim IS NOT NULL) SELECT 'click' AS series_id, count(*) AS n, round(1 - avg(pow(obs - sim, 2)) / var_pop(obs), 6) AS nse, round(1 - sqrt(pow(corr(obs, sim) - 1, 2) + pow(stddev_pop(sim) / stddev_pop(obs) - 1, 2) + pow(avg(sim) / avg(obs) - 1, 2)), 6) AS kge, round(100 * sum(sim - obs) / sum(obs), 6) AS pbias FROM c",
    P,
)
def _(s, d):
    return rounded(skill.skill(t.pairs(s, d)), 6)


@query("error_metrics", ", c AS (SELECT *, 1 + hour(ts) AS w, sim - obs AS e FROM pairs WHERE obs IS NOT NULL AND sim IS NOT NULL) SELECT 'click' AS series_id, round(sqrt(sum(w * e * e) / sum(w)), 6) AS rmse, round(sum(w * abs(e)) / sum(w), 6) AS mae, round(sum(w * e) / sum(w), 6) AS bias, round(1 - sum(w * e * e) / (sum(w * obs * obs) - pow(sum(w * obs), 2) / sum(w)), 6) AS r2, count(*) AS n FROM c", P)
def _(s, d):
    return rounded(skill.error_metrics(t.pairs(s, d).withColumn("w", 1 + F.hour("ts")), "series_id", "w"), 6)


@query(
    "series_quality",
    ", z AS (SELECT series_id, ts, nullif(value, 0) AS v FROM series), mo AS (SELECT series_id, year(ts) AS y, month(ts) AS m, count(v) AS k FROM z GROUP BY ALL), ye AS (SELECT series_id, y, sum(k) AS k FROM mo GROUP BY ALL) SELECT z.series_id, min(year(ts))::INT AS start_year, max(year(ts))::INT AS end_year, count(*) AS records, round(100 * (1 - count(v) / count(*)), 4) AS missing_pct, (SELECT count(*) FROM ye WHERE ye.series_id = z.series_id AND k >= 365) AS full_years, (SELECT count(*) FROM mo WHERE mo.series_id = z.series_id AND k >= 28) AS full_months, min(v) AS min, max(v) AS max FROM z GROUP BY z.series_id",
    D,
)
def _(s, d):
    return rounded(skill.series_quality(t.daily(s, d).withColumn("value", F.expr("nullif(value, 0)"))), 4)


@query("station_score", " SELECT station, round(sqrt(pow(x - 50, 2) + pow(y - 50, 2)), 6) AS distance, round(station % 100 - 0.1 * sqrt(pow(x - 50, 2) + pow(y - 50, 2)), 6) AS score FROM stations", S)
def _(s, d):
    return rounded(skill.station_scores(t.stations(s, d).withColumn("complete_pct", (F.col("station") % 100).cast("double")), 50, 50), 6)


@query("flow_duration_curve", "SELECT series_id, ts, value, round((row_number() OVER (PARTITION BY series_id ORDER BY value DESC, ts) - 1) / (count(*) OVER (PARTITION BY series_id) - 1) * 100, 6) AS exceedance FROM series", D)
def _(s, d):
    return rounded(skill.flow_duration(t.daily(s, d)), 6, value=2)


@query("monthly_climatology", "SELECT series_id, month(ts)::INT AS month, round(avg(value), 3) AS mean, round(stddev_pop(value), 3) AS sd, round(avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM series GROUP BY ALL", D)
def _(s, d):
    return rounded(skill.monthly_climatology(t.daily(s, d)), 3, zero_share=6)


@query("ecdf", "SELECT DISTINCT series_id, value, round(count(*) OVER (PARTITION BY series_id ORDER BY value RANGE UNBOUNDED PRECEDING) / (count(*) OVER (PARTITION BY series_id) + 1), 7) AS p FROM series", D)
def _(s, d):
    return rounded(skill.ecdf(t.daily(s, d)), 7, value=2)


@query("autocorrelation", ", l AS (SELECT series_id, k::INT AS lag, value, lag(value, k) OVER (PARTITION BY series_id, k ORDER BY pos) AS b FROM series, (VALUES (1), (2), (7)) q(k)) SELECT series_id, lag, round(corr(value, b), 6) AS r FROM l GROUP BY ALL", D)
def _(s, d):
    return rounded(skill.autocorrelation(t.daily(s, d), [1, 2, 7]), 6)


@query("aggregate_statistics", ", b AS (SELECT series_id, k::INT AS step, pos // k AS b, sum(value) AS v, count(*) AS n FROM series, (VALUES (1), (6), (24)) q(k) GROUP BY ALL HAVING count(*) = k) SELECT series_id, step, round(avg(v), 8) AS mean, round(var_pop(v), 3) AS variance, round(avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END), 6) AS dry_share FROM b GROUP BY ALL", H)
def _(s, d):
    return rounded(skill.aggregate_statistics(t.hourly(s, d), [1, 6, 24]), 8, variance=3, dry_share=6)


# space


@query("idw_grid", ", d AS (SELECT cell, station, value, pow(c.x - s.x, 2) + pow(c.y - s.y, 2) AS d2 FROM cells c, stations s) SELECT cell, round(coalesce(arg_min(value, station) FILTER (d2 = 0), sum(value / nullif(d2, 0)) / sum(1 / nullif(d2, 0))), 4) AS value FROM d GROUP BY cell", S)
def _(s, d):
    return rounded(spatial.idw(t.cells(s), t.stations(s, d)), 4)


@query("idw_loo", ", d AS (SELECT a.station, a.value AS own, b.value, greatest(pow(a.x - b.x, 2) + pow(a.y - b.y, 2), 1e-12) AS d2 FROM stations a JOIN stations b ON a.station <> b.station) SELECT station, own AS value, round(sum(value / d2) / sum(1 / d2), 4) AS predicted FROM d GROUP BY ALL", S)
def _(s, d):
    return rounded(spatial.idw_left_out(t.stations(s, d)), 4, value=2)


@query("idw_timeseries", ", ser AS (SELECT l_suppkey AS station, date_trunc('year', l_shipdate)::TIMESTAMP AS ts, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY ALL), w AS (SELECT cell, station, 1 / greatest(pow(c.x - s.x, 2) + pow(c.y - s.y, 2), 1e-12) AS w FROM cells c, stations s) SELECT cell, ts, round(sum(w * value) / sum(w), 4) AS value FROM ser JOIN w USING (station) GROUP BY ALL", S)
def _(s, d):
    ser = t.read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("station"), F.date_trunc("year", "l_shipdate").cast("timestamp_ntz").alias("ts")).agg(F.round(F.sum("l_quantity"), 2).alias("value"))
    return rounded(spatial.idw_series(t.cells(s), t.stations(s, d), ser), 4)


NEAR = ", d AS (SELECT cell, station, sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2)) AS distance FROM cells c, stations s), k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY distance, station) AS place FROM d)"


@query("nearest_centroid", NEAR + " SELECT cell, station, round(distance, 6) AS distance, place FROM k WHERE place <= 3", S)
def _(s, d):
    return rounded(spatial.nearest(t.cells(s), t.stations(s, d), 3), 6)


@query("knn_weights", NEAR + " SELECT cell, station, round(1 / greatest(distance, 1e-12) / sum(1 / greatest(distance, 1e-12)) OVER (PARTITION BY cell), 7) AS weight FROM k WHERE place <= 3", S)
def _(s, d):
    return rounded(spatial.knn_weights(t.cells(s), t.stations(s, d), 3), 7)


@query("rbf_weights", ", d AS (SELECT cell, station, exp(-(pow(c.x - s.x, 2) + pow(c.y - s.y, 2)) / (2 * 20.0 * 20.0)) AS e FROM cells c, stations s) SELECT cell, station, round(e / sum(e) OVER (PARTITION BY cell), 7) AS weight FROM d", S)
def _(s, d):
    return rounded(spatial.rbf_weights(t.cells(s), t.stations(s, d), 20.0), 7)


@query("voronoi_weights", NEAR + " SELECT s.station, count(cell) AS weight FROM stations s LEFT JOIN (SELECT * FROM k WHERE place = 1) k ON k.station = s.station GROUP BY ALL", S)
def _(s, d):
    return spatial.voronoi_weights(t.cells(s), t.stations(s, d))


# ensembles and soils


@query("ensemble_spatial_stats", "SELECT cell, count(*) AS n, round(avg(depth), 5) AS mean, round(median(depth), 5) AS median, round(stddev_pop(depth), 5) AS std, max(depth) AS max FROM raster WHERE depth IS NOT NULL GROUP BY cell", R)
def _(s, d):
    return rounded(ensemble.spatial_stats(t.raster(s, d)), 5)


@query("flooded_area", "SELECT sim, count(*) FILTER (depth >= 2.5) * 25.0::DOUBLE AS area, round(avg(depth), 6) AS depth_mean FROM raster GROUP BY sim", R)
def _(s, d):
    return rounded(ensemble.flooded_area(t.raster(s, d), 25.0, 2.5), 6)


@query("inundation_frequency", "SELECT cell, round(avg((depth IS NOT NULL)::INT), 6) AS frequency FROM raster GROUP BY cell", R)
def _(s, d):
    return rounded(ensemble.inundation_frequency(t.raster(s, d)), 6)


@query("roughness_regression", ", a AS (SELECT sim, count(*) FILTER (depth >= 2.5) * 25.0 AS area, avg(depth) AS m FROM raster GROUP BY sim) SELECT round(regr_slope(area, m), 3) AS slope, round(regr_intercept(area, m), 3) AS intercept, round(regr_r2(area, m), 6) AS r2, round(corr(m, area), 6) AS pearson FROM a", R)
def _(s, d):
    return rounded(ensemble.area_regression(ensemble.flooded_area(t.raster(s, d), 25.0, 2.5), "depth_mean", "area"), 3, r2=6, pearson=6)


@query("mad_outliers", ", a AS (SELECT cell AS sim, stddev_pop(depth) AS s, max(depth) AS m FROM raster WHERE depth IS NOT NULL GROUP BY cell), l AS (SELECT sim, 0 AS o, 'depth_std' AS metric, s AS v FROM a UNION ALL SELECT sim, 1, 'depth_max', m FROM a), e AS (SELECT metric, median(v) AS med FROM l GROUP BY ALL), v AS (SELECT l.*, abs(v - med) AS dev FROM l JOIN e USING (metric)), q AS (SELECT metric, median(dev) AS mad FROM v GROUP BY ALL), z AS (SELECT sim, o, v.metric, dev / (1.4826 * mad) AS z FROM v JOIN q USING (metric) WHERE mad > 0) SELECT sim, arg_min(metric, o) AS metric, round(arg_min(z, o), 5) AS z FROM z WHERE z > 2 GROUP BY sim", R)
def _(s, d):
    a = t.raster(s, d).where("depth IS NOT NULL").groupBy(F.col("cell").alias("sim")).agg(F.stddev_pop("depth").alias("depth_std"), F.max("depth").alias("depth_max"))
    return rounded(ensemble.mad_outliers(a, ["depth_std", "depth_max"], limit=2.0), 5)


@query("pixel_return_period", ", k AS (SELECT cell, depth, row_number() OVER (PARTITION BY cell ORDER BY depth) - 1 AS i, count(*) OVER (PARTITION BY cell) AS n FROM raster WHERE depth IS NOT NULL) SELECT cell, p::INT AS period, depth FROM k, (VALUES (5), (10), (25), (50), (100), (200), (500), (1000)) q(p) WHERE i = greatest(0, least(n - 1, round_even(n * (1 - 1 / (p * 0.5)), 0) - 1))", R)
def _(s, d):
    return ensemble.pixel_return_period(t.raster(s, d), 0.5)


@query("depth_reconstruction", ", w AS (SELECT e::INT AS event, s::INT AS sim, (1.0::DOUBLE / (1 + abs(e - s))) AS w FROM range(1, 5) a(e), range(1, 8) b(s)) SELECT event, cell, round(sum(w * coalesce(depth, 0)), 8) AS depth FROM w JOIN raster USING (sim) GROUP BY ALL", R)
def _(s, d):
    w = s.range(1, 5).selectExpr("CAST(id AS INT) AS event", "explode(sequence(1, 7)) AS sim").withColumn("weight", 1.0 / (1 + F.abs(F.col("event") - F.col("sim"))))
    return rounded(ensemble.reconstruct(w, t.raster(s, d)), 8)


@query("soil_texture", f"SELECT texture::INT AS texture, count(*) AS n FROM (SELECT {ensemble.texture_sql()} AS texture FROM soils) GROUP BY ALL", O)
def _(s, d):
    return ensemble.soil_texture(t.soils(s, d)).groupBy("texture").agg(F.count("*").alias("n"))


@query("soil_mode", f", n AS (SELECT pixel, {ensemble.texture_sql()} AS texture, count(*) AS k FROM soils GROUP BY ALL) SELECT pixel, arg_min(texture, (-k, texture))::INT AS texture FROM n GROUP BY pixel", O)
def _(s, d):
    return ensemble.soil_mode(t.soils(s, d))


# dependence


@query("spearman_matrix", ", c AS (SELECT hour(ts) AS g, obs, sim FROM pairs WHERE obs IS NOT NULL AND sim IS NOT NULL), r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY obs) + (count(*) OVER (PARTITION BY g, obs) - 1) / 2 AS a, rank() OVER (PARTITION BY g ORDER BY sim) + (count(*) OVER (PARTITION BY g, sim) - 1) / 2 AS b FROM c) SELECT g::INT AS g, count(*) AS n, CASE WHEN count(*) >= 8 THEN round(corr(a, b), 6) END AS rho FROM r GROUP BY g", P)
def _(s, d):
    return rounded(copulas.spearman(t.pairs(s, d).withColumn("g", F.hour("ts")), "obs", "sim", "g"), 6)


@query("kendall_tau", ", c AS (SELECT hour(ts) AS g, obs, sim, row_number() OVER (ORDER BY ts) AS i FROM pairs WHERE obs IS NOT NULL AND sim IS NOT NULL), p AS (SELECT a.g, sign(b.obs - a.obs) AS x, sign(b.sim - a.sim) AS y FROM c a JOIN c b ON a.g = b.g AND a.i < b.i) SELECT g::INT AS g, ((1 + sqrt(1 + 8 * count(*))) / 2)::BIGINT AS n, round(sum(x * y) / nullif(sqrt(sum(abs(x))::DOUBLE * sum(abs(y))), 0), 6) AS tau FROM p GROUP BY g", P)
def _(s, d):
    return rounded(copulas.kendall(t.pairs(s, d).withColumn("g", F.hour("ts")), "obs", "sim", "g"), 6)


UV = ", c AS (SELECT ts, obs, sim, 'all' AS g FROM pairs WHERE obs IS NOT NULL AND sim IS NOT NULL), u AS (SELECT ts, (rank() OVER (ORDER BY obs) + (count(*) OVER (PARTITION BY obs) - 1) / 2) / (count(*) OVER () + 1) AS u, (rank() OVER (ORDER BY sim) + (count(*) OVER (PARTITION BY sim) - 1) / 2) / (count(*) OVER () + 1) AS v FROM c)"


def _uv(s, d):
    p = t.pairs(s, d).where("obs IS NOT NULL AND sim IS NOT NULL").withColumn("g", F.lit("all"))
    return copulas.pseudo_observations(p, ["obs", "sim"], "g").select("ts", F.col("u_obs").alias("u"), F.col("u_sim").alias("v"))


@query("copula_cdf", UV + " SELECT ts, round(exp(-pow(pow(-ln(u), 1.5) + pow(-ln(v), 1.5), 1 / 1.5)), 7) AS gumbel, round(pow(greatest(pow(u, -1.2) + pow(v, -1.2) - 1, 0), -1 / 1.2), 7) AS clayton, round(-1 / 3.0 * ln(1 + (exp(-3 * u) - 1) * (exp(-3 * v) - 1) / (exp(-3) - 1)), 7) AS frank FROM u", P)
def _(s, d):
    return rounded(_uv(s, d).select("ts", dist.copula_cdf("gumbel", 1.5, "u", "v").alias("gumbel"), dist.copula_cdf("clayton", 1.2, "u", "v").alias("clayton"), dist.copula_cdf("frank", 3.0, "u", "v").alias("frank")), 7)


@query("joint_return_period", UV + ", k AS (SELECT *, exp(-pow(pow(-ln(u), 1.5) + pow(-ln(v), 1.5), 1 / 1.5)) AS c FROM u) SELECT ts, round(1 - c, 7) AS p_or, round(greatest(0, 1 - u - v + c), 7) AS p_and, round(1 / greatest(1 - c, 1e-12), 4) AS t_or FROM k", P)
def _(s, d):
    return rounded(copulas.joint_exceedance(_uv(s, d), "gumbel", 1.5, "u", "v").select("ts", "p_or", "p_and", "t_or"), 7, t_or=4)


@query("kendall_function", UV + ", k AS (SELECT exp(-pow(pow(-ln(u), 1.5) + pow(-ln(v), 1.5), 1 / 1.5)) AS c FROM u) SELECT t::DOUBLE AS t, round(avg((c <= t)::INT), 7) AS k FROM k, (VALUES (0.1), (0.3), (0.5), (0.7), (0.9)) q(t) GROUP BY t", P)
def _(s, d):
    c = _uv(s, d).select(dist.copula_cdf("gumbel", 1.5, "u", "v").alias("c"))
    return rounded(copulas.kendall_function(c, "c", [0.1, 0.3, 0.5, 0.7, 0.9]), 7)


@query("tail_dependence", "SELECT tau::DOUBLE AS tau, round(greatest(1.001, 1 / (1 - tau)), 7) AS theta_gumbel, round(greatest(1e-4, 2 * tau / (1 - tau)), 7) AS theta_clayton, round(CASE WHEN 1 / (1 - tau) > 1 THEN 2 - pow(2, 1 / greatest(1.001, 1 / (1 - tau))) ELSE 2 - pow(2, 1 / 1.001) END, 7) AS upper_gumbel, round(pow(2, -1 / greatest(1e-4, 2 * tau / (1 - tau))), 7) AS lower_clayton FROM (VALUES (0.1), (0.3), (0.5), (0.8)) q(tau)")
def _(s, d):
    return rounded(copulas.theta_of_tau(s.createDataFrame([(0.1,), (0.3,), (0.5,), (0.8,)], "tau double")), 7)


# joint distributions

TAU = ", c AS (SELECT hour(ts) AS g, obs, sim, row_number() OVER (ORDER BY ts) AS i FROM pairs WHERE obs IS NOT NULL AND sim IS NOT NULL), p AS (SELECT a.g, sign(b.obs - a.obs) AS x, sign(b.sim - a.sim) AS y FROM c a JOIN c b ON a.g = b.g AND a.i < b.i), k AS (SELECT g::INT AS g, round(sum(x * y) / nullif(sqrt(sum(abs(x))::DOUBLE * sum(abs(y))), 0), 6) AS tau FROM p GROUP BY g), th AS (SELECT g, greatest(1.001, 1 / (1 - least(tau, 0.999))) AS theta FROM k WHERE tau IS NOT NULL)"


def _dependence(s, d):
    tau = copulas.kendall(t.pairs(s, d).withColumn("g", F.hour("ts")), "obs", "sim", "g").where("tau IS NOT NULL")
    return copulas.theta_of_tau(tau.select("g", F.round("tau", 6).alias("tau"))).select("g", F.col("theta_gumbel").alias("theta"))


@query("contour_or", TAU + ", u AS (SELECT g, theta, i::INT AS i, 0.9001 + i * (0.0998 / 39) AS u FROM th, range(40) q(i)) SELECT g, i, round(u, 6) AS u, round(exp(-pow(pow(-ln(0.9::DOUBLE), theta) - pow(-ln(u), theta), 1 / theta)), 6) AS v FROM u", P)
def _(s, d):
    return rounded(joint.contour(_dependence(s, d), "gumbel", 10.0, "or", 40).select("g", "i", "u", "v"), 6)


@query("contour_and", TAU + " SELECT g, i::INT AS i, 0.1::DOUBLE AS p_and FROM th, range(40) q(i)", P)
def _(s, d):
    k = joint.contour(_dependence(s, d), "gumbel", 10.0, "and", 40)
    return rounded(k.select("g", "i", (1 - F.col("u") - F.col("v") + dist.copula_cdf("gumbel", "theta", "u", "v")).alias("p_and")), 8)


THREE = ", w AS (SELECT ts, max(value) FILTER (series_id = 'click') AS a, max(value) FILTER (series_id = 'view') AS b, max(value) FILTER (series_id = 'purchase') AS c FROM series GROUP BY ts), r AS (SELECT ts, " + ", ".join(f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2) / (count(*) OVER () + 1) AS u{x}" for x in "abc") + " FROM w)"


@query(
    "trivariate_exceedance",
    THREE + ", l AS (SELECT ts, ua, ub, uc, pow(-ln(ua), 1.5) AS x, pow(-ln(ub), 1.5) AS y, pow(-ln(uc), 1.5) AS z FROM r), k AS (SELECT *, 1 - exp(-pow(x + y + z, 1 / 1.5)) AS p_or, greatest(0, 1 - ua - ub - uc + exp(-pow(x + y, 1 / 1.5)) + exp(-pow(x + z, 1 / 1.5)) + exp(-pow(y + z, 1 / 1.5)) - exp(-pow(x + y + z, 1 / 1.5))) AS p_and FROM l) SELECT ts, round(p_or, 7) AS p_or, round(p_and, 7) AS p_and, round(1 / greatest(p_or, 1e-12), 4) AS t_or FROM k",
    H,
)
def _(s, d):
    pick = lambda k: F.max(F.when(F.col("series_id") == k, F.col("value")))
    w = t.hourly(s, d).groupBy("ts").agg(pick("click").alias("a"), pick("view").alias("b"), pick("purchase").alias("c")).withColumn("g", F.lit("all"))
    u = copulas.pseudo_observations(w, ["a", "b", "c"], "g")
    return rounded(joint.exceedance_of_three(u, "gumbel", 1.5, "u_a", "u_b", "u_c").select("ts", "p_or", "p_and", "t_or"), 7, t_or=4)


@query("kendall_level", UV + ", k AS (SELECT pow(greatest(pow(u, -1.2) + pow(v, -1.2) - 1, 0), -1 / 1.2) AS c FROM u) SELECT round(quantile_cont(c, 0.95), 7) AS t FROM k", P)
def _(s, d):
    return rounded(joint.kendall_level(_uv(s, d).select(dist.copula_cdf("clayton", 1.2, "u", "v").alias("c")), "c", 20.0), 7)


@query(
    "design_ensemble",
    UV + ", k AS (SELECT ts, u, v, pow(greatest(pow(u, -1.2) + pow(v, -1.2) - 1, 0), -1 / 1.2) AS c, 2.2 * pow(u * v, -2.2) * pow(pow(u, -1.2) + pow(v, -1.2) - 1, -2 - 1 / 1.2) AS density FROM u), l AS (SELECT quantile_cont(c, 0.9) AS t FROM k), o AS (SELECT k.*, abs(c - t) / t AS off FROM k, l), b AS (SELECT min(w) AS w FROM (SELECT 0.05 * pow(2, j) AS w, count(*) AS n FROM o, range(12) q(j) WHERE off <= 0.05 * pow(2, j) GROUP BY ALL) WHERE n >= 10) SELECT ts, round(c, 7) AS c, round(density, 6) AS density FROM o, b WHERE off <= w ORDER BY o.density DESC, u, v LIMIT 10",
    P,
)
def _(s, d):
    return rounded(joint.design_ensemble(_uv(s, d), "clayton", 1.2, "u", "v", 10.0, 10).select("ts", "c", "density"), 7, density=6)


@query("discrete_marginal", "WITH n AS (SELECT event_type AS g, hour(ts)::INT AS value, count(*) AS k FROM events GROUP BY ALL) SELECT g, value, round(k / sum(k) OVER (PARTITION BY g), 7) AS p, round(sum(k) OVER (PARTITION BY g ORDER BY value) / sum(k) OVER (PARTITION BY g), 7) AS cumulative FROM n")
def _(s, d):
    e = t.read(s, d, "events").select(F.col("event_type").alias("g"), F.hour("ts").alias("h"))
    return rounded(joint.discrete_marginal(e, "h", "g"), 7)


@query("fitted_marginals", "SELECT station, 'value' AS variable, 'lognormal' AS family, round(avg(ln(value)), 6) AS a, round(stddev_pop(ln(value)), 6) AS b, 0.0::DOUBLE AS c, round(4 + count(*) * (ln(2 * pi() * var_pop(ln(value))) + 1) + 2 * sum(ln(value)), 3) AS aic, count(*) AS n FROM yearly GROUP BY station HAVING count(*) >= 5", N)
def _(s, d):
    return rounded(joint.fit_marginals(t.yearly_by_nation(s, d), ["value"], ("lognormal",), "station"), 6, aic=3)


@query("most_probable_event")
def _(s, d):
    p = t.pairs(s, d).withColumn("g", F.hour("ts").cast("string")).where("obs > 0 AND sim > 0")
    m = joint.fit_marginals(p, ["obs", "sim"], group="g")
    curve = joint.contour(_dependence(s, d).withColumn("g", F.col("g").cast("string")), "gumbel", 10.0, "and", 100)
    both = joint.curve_in_units(curve, m.where("variable = 'obs'"), m.where("variable = 'sim'"), "g")
    return rounded(joint.most_probable(both, "gumbel", "g"), 4)


# design storms


@query("idf_temez", "SELECT series_id, h::DOUBLE AS duration, round(p24 * pow(h / 24.0, 0.72), 3) AS depth, round(p24 * pow(h / 24.0, 0.72) / h, 3) AS intensity FROM (SELECT series_id, max(value) AS p24 FROM series GROUP BY ALL), (VALUES (1), (3), (6), (12), (24)) q(h)", D)
def _(s, d):
    p = t.daily(s, d).groupBy("series_id").agg(F.max("value").alias("p24"))
    return rounded(hydrology.idf_table(p, [1, 3, 6, 12, 24]).drop("p24"), 3)


@query("alternating_blocks", ", d AS (SELECT series_id, h AS duration, p24 * pow(h / 24.0, 0.72) AS depth FROM (SELECT series_id, max(value) AS p24 FROM series GROUP BY ALL), range(1, 8) q(h)), i AS (SELECT series_id, duration, depth - coalesce(lag(depth) OVER (PARTITION BY series_id ORDER BY duration), 0) AS inc FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY inc DESC, duration) AS r FROM i) SELECT series_id, CASE WHEN r % 2 = 0 THEN 4 + r // 2 ELSE 4 - r // 2 END AS slot, round(inc, 3) AS block FROM r", D)
def _(s, d):
    p = t.daily(s, d).groupBy("series_id").agg(F.max("value").alias("p24"))
    return rounded(hydrology.alternating_blocks(hydrology.idf_table(p, list(range(1, 8))), "series_id"), 3)


@query("scs_cn_runoff", ", p AS (SELECT series_id, ts, value, sum(value / 100) OVER (PARTITION BY series_id ORDER BY ts) AS p FROM series), q AS (SELECT *, CASE WHEN p > 0.2 * (25400 / 75.0 - 254) THEN pow(p - 0.2 * (25400 / 75.0 - 254), 2) / (p + 0.8 * (25400 / 75.0 - 254)) ELSE 0 END AS q FROM p) SELECT series_id, ts, round(value / 100, 6) AS rain, round(q - coalesce(lag(q) OVER (PARTITION BY series_id ORDER BY ts), 0), 5) AS runoff FROM q", H)
def _(s, d):
    return rounded(hydrology.scs_runoff(t.hourly(s, d).withColumn("value", F.col("value") / 100), 75), 6, runoff=5)


@query("unit_hydrograph", ", k AS (SELECT series_id, pos + j AS pos, value * u AS f FROM series, (VALUES (0, 0.2), (1, 0.5), (2, 0.3)) q(j, u)) SELECT series_id, pos, round(sum(f), 5) AS flow FROM k GROUP BY ALL", H)
def _(s, d):
    return rounded(hydrology.unit_hydrograph(t.hourly(s, d), [0.2, 0.5, 0.3], value="value"), 5)


@query("clark_kirpich", "SELECT s_suppkey AS basin, round(0.0195 * pow(1000 + s_suppkey, 0.77) * pow(0.05, -0.385), 6) AS tc, round(0.6 * 0.0195 * pow(1000 + s_suppkey, 0.77) * pow(0.05, -0.385), 6) AS r, round((1000 + s_suppkey) / 1.5 / 3600, 3) AS k FROM supplier")
def _(s, d):
    x = t.read(s, d, "supplier").select(F.col("s_suppkey").alias("basin"), (F.lit(1000.0) + F.col("s_suppkey")).alias("l"))
    tc, r = hydrology.clark(F.col("l"), F.lit(0.05))
    return rounded(x.select("basin", tc.alias("tc"), r.alias("r"), hydrology.muskingum(F.col("l"), F.lit(1.5)).alias("k")), 6)


# parsers


@query("dms_parse", "SELECT * FROM (VALUES ('402312N', 40.386667), ('0034512W', -3.753333), ('41,5', 41.5), ('x', NULL)) q(raw, degrees)")
def _(s, d):
    x = s.createDataFrame([("402312N",), ("0034512W",), ("41,5",), ("x",)], "raw string")
    return x.select("raw", F.round(parsers.dms_degrees(F.col("raw")), 6).alias("degrees"))


@query("wind_rose_degrees", "SELECT * FROM (VALUES ('N', 0.0::DOUBLE), ('ENE', 67.5), ('W', 270.0), ('calm', NULL)) q(raw, degrees)")
def _(s, d):
    return s.createDataFrame([("N",), ("ENE",), ("W",), ("calm",)], "raw string").select("raw", parsers.rose_degrees(F.col("raw")).alias("degrees"))


@query("grdc_parse", "SELECT * FROM (VALUES (TIMESTAMP '2000-01-01', 45.3::DOUBLE), (TIMESTAMP '2000-01-02', 46.1), (TIMESTAMP '2000-01-03', NULL), (TIMESTAMP '2000-01-04', NULL)) q(date, discharge)")
def _(s, d):
    lines = ["# GRDC-No.: 1", "YYYY-MM-DD;hh:mm; Value", "2000-01-01; 00; 45.30", "2000-01-02; 00; 46.10", "2000-01-03; 00; -999.0", "2000-01-04; 00; x"]
    return parsers.grdc_rows(s.createDataFrame([(x,) for x in lines], "value string")).withColumn("date", F.col("date").cast("timestamp_ntz"))


@query("event_props_json", "SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY ALL")
def _(s, d):
    e = t.read(s, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("complete_combinations", "SELECT l_suppkey FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY ALL HAVING count(DISTINCT l_linenumber) = 3")
def _(s, d):
    return parsers.complete_combinations(t.read(s, d, "lineitem"), ["l_suppkey"], "l_linenumber", [1, 2, 3])


# kernels: no SQL form


@query("gev_mle")
def _(s, d):
    return rounded(extremes.gev_mle(annual(s, d)), 3)


@query("gpd_mle")
def _(s, d):
    return rounded(extremes.gpd_mle(t.daily(s, d).where(F.col("value") > FLOOD).select("series_id", (F.col("value") - FLOOD).alias("value"))), 3)


@query("bootstrap_ci")
def _(s, d):
    return rounded(extremes.return_level_ci(annual(s, d), 50.0, 200), 3)


for _family, _theta in (("gaussian", 0.6), ("gumbel", 2.0), ("clayton", 2.0), ("frank", 5.0)):

    @query(f"copula_samples_{_family}")
    def _(s, d, f=_family, th=_theta):
        return copulas.sample(s, f, th, 5000)


@query("sdm_precip")
def _(s, d):
    return rounded(bias.scaled_distribution_mapping(*_roles(s, d), variable="precipitation"), 4)


@query("sdm_temperature")
def _(s, d):
    return rounded(bias.scaled_distribution_mapping(*_roles(s, d), variable="temperature"), 4)


@query("marginal_bic")
def _(s, d):
    return rounded(extremes.best_marginal(annual(s, d)), 3)


@query("fisher_samples")
def _(s, d):
    return rounded(extremes.gev_fisher(annual(s, d), 100), 3)


@query("gev_posterior_levels")
def _(s, d):
    return rounded(extremes.posterior_levels(extremes.gev_mcmc(annual(s, d), 400, 200), 50.0), 3)


@query("heterogeneity_h1")
def _(s, d):
    return rounded(regional.heterogeneity(t.yearly_by_nation(s, d), 200), 4)


def _design(s, d):
    return t.read(s, d, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("row_id"), F.expr("transform(embedding, x -> CAST(x AS DOUBLE))").alias("features"))


@query(
    "design_standardized",
    "WITH f AS (SELECT vec_id AS row_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) SELECT row_id, k::INT AS k, round((v - avg(v) OVER (PARTITION BY k)) / coalesce(nullif(stddev_pop(v) OVER (PARTITION BY k), 0), 1), 6) AS z FROM f",
)
def _(s, d):
    return rounded(design.standardize(_design(s, d)).select("row_id", F.posexplode("features").alias("k", "z")), 6)


@query("maxdiss_order")
def _(s, d):
    chosen = design.maxdiss(_design(s, d), 8)
    return s.createDataFrame(list(enumerate(chosen)), "place int, row_id long")


@query("design_weights")
def _(s, d):
    x = _design(s, d)
    return design.design_weights(x, design.maxdiss(x, 8))


@query("propagate")
def _(s, d):
    p = design.propagate(_design(s, d), lambda x: np.sin(x[:, 0]) + x[:, 1] ** 2, 80)
    return s.createDataFrame([(p.strategy, round(p.r2, 4), p.runs, round(p.quantile, 4))], "strategy string, r2 double, runs int, quantile double")


@query("kriging_grid")
def _(s, d):
    return rounded(fields.kriging(t.cells(s), t.stations(s, d)), 4)


@query("gp_grid")
def _(s, d):
    return rounded(fields.gaussian_process(t.cells(s), t.stations(s, d)), 4)


@query("nsrp_simulation")
def _(s, d):
    return rounded(fields.nsrp(s, 60, 0.3, 5, 3.0, 2.0, 1.5), 6)


def _segments(s, d):
    x = t.daily(s, d)
    e = events.flood_events(x, FLOOD, PEAK).withColumn("event_id", F.concat_ws("-", "series_id", "start_pos"))
    return events._segments(events.with_pos(x).withColumn("pos", F.col("pos").cast("long")), e.select("series_id", "event_id", "start_pos", "end_pos")).select("event_id", "pos", "value")


@query("shape_classes")
def _(s, d):
    return fields.shape_classes(_segments(s, d), 4)


@query("regimes")
def _(s, d):
    a = ensemble.spatial_stats(t.raster(s, d)).select("cell", "mean")
    return rounded(fields.regimes(a, "mean"), 5)


# preparation of series


@query("common_period", ", w AS (SELECT * FROM series WHERE value > 0), k AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT min(ts) AS a, max(ts) AS b FROM w GROUP BY series_id)) SELECT w.series_id, w.ts::TIMESTAMP AS ts, w.value FROM w, k WHERE w.ts BETWEEN k.a AND k.b", D)
def _(s, d):
    return series.common_period(t.daily(s, d).where("value > 0"))


@query("standardised_mean", ", m AS (SELECT series_id, avg(value) AS m, stddev_samp(value) AS s FROM series GROUP BY series_id) SELECT ts::TIMESTAMP AS ts, round(avg((value - m) / s), 6) AS z, count(*) AS n FROM series JOIN m USING (series_id) WHERE s > 0 GROUP BY ts", D)
def _(s, d):
    return rounded(series.standardised_mean(t.daily(s, d)), 6)


@query("complete_maxima", "SELECT series_id, year(ts)::INT AS year, max(value) AS value FROM series WHERE value > 0 GROUP BY ALL HAVING count(*) >= 240", D)
def _(s, d):
    return series.complete_maxima(t.daily(s, d).where("value > 0"), 240)


@query(
    "last_duplicate_monthly_mean",
    "WITH l AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, arg_max(value, event_id) AS value FROM events GROUP BY ALL) SELECT series_id, date_trunc('month', ts)::DATE AS month, round(avg(value), 6) AS value FROM l GROUP BY ALL",
)
def _(s, d):
    e = t.read(s, d, "events").select(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts"), "value", "event_id")
    return rounded(series.monthly_mean(series.last_of_each(e, "event_id")), 6)


@query(
    "carried_forward",
    ", w AS (SELECT * FROM series WHERE value > 0) SELECT s.series_id, s.ts::TIMESTAMP AS ts, w.value FROM series s ASOF LEFT JOIN w ON s.series_id = w.series_id AND s.ts >= w.ts",
    D,
)
def _(s, d):
    x = t.daily(s, d)
    return series.carried_forward(x.where("value > 0"), x.select("series_id", "ts"))


@query("depth_variation", "SELECT cell, round(stddev_pop(depth) / nullif(avg(depth), 0), 6) AS cv FROM raster GROUP BY cell", R)
def _(s, d):
    return rounded(series.variation(t.raster(s, d), "cell", "depth"), 6)


@query("well_covered", ", n AS (SELECT station, count(DISTINCT year) AS n FROM yearly WHERE value > 250000 GROUP BY station), k AS (SELECT count(DISTINCT year) AS total FROM yearly) SELECT station AS series_id, n, total FROM n, k WHERE n >= 0.5 * total", N)
def _(s, d):
    y = t.yearly_by_nation(s, d).select(F.col("station").alias("series_id"), F.col("year").alias("ts"), F.when(F.col("value") > 250000, F.col("value")).alias("value"))
    return series.well_covered(y, 0.5)


@query("standardised_maxima", ", m AS (SELECT series_id, avg(value) AS m, stddev_pop(value) AS s FROM series GROUP BY series_id HAVING stddev_pop(value) > 0), z AS (SELECT year(ts)::INT AS year, max((value - m) / s) AS z FROM series JOIN m USING (series_id) GROUP BY ALL) SELECT series_id, year, round(z, 6) AS z, round(m + s * z, 2) AS back FROM m, z", D)
def _(s, d):
    return rounded(series.standardised_maxima(t.daily(s, d)), 6, back=2)


AT_STEPS = """, w AS (SELECT series_id, ts, value FROM series WHERE value > 0),
steps AS (SELECT series_id, ts + INTERVAL 10 MINUTE AS ts FROM series),
b AS (SELECT s.series_id, s.ts, w.ts AS ta, w.value AS a FROM steps s ASOF LEFT JOIN w ON s.series_id = w.series_id AND s.ts >= w.ts),
f AS (SELECT s.series_id, s.ts, w.ts AS tb, w.value AS b FROM steps s ASOF LEFT JOIN w ON s.series_id = w.series_id AND s.ts <= w.ts),
g AS (SELECT *, epoch(ts) - epoch(ta) AS before, epoch(tb) - epoch(ts) AS after FROM b JOIN f USING (series_id, ts))
SELECT series_id, ts::TIMESTAMP AS ts, CASE WHEN tb IS NULL OR before <= after THEN a ELSE b END AS nearest, round(CASE WHEN before + after = 0 THEN a ELSE a + (b - a) * (before / (before + after)) END, 6) AS linear FROM g"""


@query("values_at_steps", AT_STEPS, H)
def _(s, d):
    x = t.hourly(s, d)
    return rounded(series.at_steps(x.where("value > 0"), x.select("series_id", (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("ts"))), 6)


@query("type_medians", "SELECT series_id, hour(ts)::INT AS step, round(median(value), 6) AS median FROM series GROUP BY ALL", H)
def _(s, d):
    return rounded(series.type_medians(t.hourly(s, d).withColumn("step", F.hour("ts")), "series_id", "step"), 6)


@query("two_sample_t", ", g AS (SELECT count(obs) FILTER (hour(ts) < 12) AS n_a, count(obs) FILTER (hour(ts) >= 12) AS n_b, avg(obs) FILTER (hour(ts) < 12) AS mean_a, avg(obs) FILTER (hour(ts) >= 12) AS mean_b, var_samp(obs) FILTER (hour(ts) < 12) AS v_a, var_samp(obs) FILTER (hour(ts) >= 12) AS v_b FROM pairs) SELECT n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round((mean_a - mean_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b)), 6) AS t, n_a + n_b - 2 AS dof FROM g", P)
def _(s, d):
    return rounded(series.two_sample_t(t.pairs(s, d).withColumn("early", F.hour("ts") < 12), "early", "obs"), 6)


@query("quantile_errors", ", q AS (SELECT unnest(['obs', 'sim']) AS variable, unnest([obs, sim]) AS v, hour(ts) < 12 AS early FROM pairs), p AS (SELECT unnest([0.1, 0.5, 0.9, 0.99])::DOUBLE AS p), e AS (SELECT variable, p, quantile_cont(v, [0.1, 0.5, 0.9, 0.99]) FILTER (early) AS a, quantile_cont(v, [0.1, 0.5, 0.9, 0.99]) FILTER (NOT early) AS b FROM q, p GROUP BY ALL), i AS (SELECT variable, p, a[list_position([0.1, 0.5, 0.9, 0.99]::DOUBLE[], p)] AS o, b[list_position([0.1, 0.5, 0.9, 0.99]::DOUBLE[], p)] AS s FROM e) SELECT variable, p, round(o, 5) AS observed, round(s, 5) AS synthetic, round(s - o, 5) AS error FROM i", P)
def _(s, d):
    x = t.pairs(s, d)
    return rounded(series.quantile_errors(x.where(F.hour("ts") < 12), x.where(F.hour("ts") >= 12), ["obs", "sim"], [0.1, 0.5, 0.9, 0.99]), 5)


# runoff and ensembles, continued


@query("idf_change", ", q AS (SELECT series_id, year(value_year) <= 1998 AS past, value FROM (SELECT series_id, block_end AS value_year, value FROM annual)), m AS (SELECT series_id, quantile_cont(value, 0.5) FILTER (past) AS c, quantile_cont(value, 0.5) FILTER (NOT past) AS f FROM q GROUP BY ALL), u AS (SELECT series_id, unnest([1, 6, 24])::DOUBLE AS duration, c, f FROM m) SELECT series_id, duration, round(f / c, 6) AS ratio FROM u", D, ANNUAL)
def _(s, d):
    def depths(past: bool) -> DataFrame:
        early = F.year("block_end") <= 1998
        p24 = annual(s, d).where(early if past else ~early).groupBy("series_id").agg(F.percentile("value", 0.5).alias("p24"))
        return hydrology.idf_table(p24, [1, 6, 24])

    return rounded(hydrology.idf_change(depths(True), depths(False), ["series_id", "duration"]), 6)


@query("linear_reservoir", "SELECT a.series_id, a.ts::TIMESTAMP AS ts, round(sum(b.value * 0.4 * pow(0.6, a.pos - b.pos)), 5) AS flow FROM series a JOIN series b ON a.series_id = b.series_id AND b.pos <= a.pos GROUP BY ALL", H)
def _(s, d):
    return rounded(hydrology.linear_reservoir(t.hourly(s, d), 0.4), 5)


@query("rating_curve", "WITH p AS (SELECT l_linenumber::INT AS station, l_quantity::DOUBLE AS q, avg(l_extendedprice) AS stage FROM lineitem GROUP BY ALL), g AS (SELECT station, max(ln(1 + q)) - min(ln(1 + q)) AS span FROM p GROUP BY station), a AS (SELECT station, i + 0.3::DOUBLE AS q FROM g, range(61) t(i)), k AS (SELECT a.station, a.q, stage, abs(ln(1 + a.q) - ln(1 + p.q)) / span AS dist, row_number() OVER (PARTITION BY a.station, a.q ORDER BY abs(ln(1 + a.q) - ln(1 + p.q)), p.q) AS r FROM a JOIN p USING (station) JOIN g USING (station)) SELECT station, q, round(sum(stage / greatest(dist, 1e-12)) / sum(1 / greatest(dist, 1e-12)), 3) AS stage FROM k WHERE r <= 3 GROUP BY ALL")
def _(s, d):
    p = t.read(s, d, "lineitem").selectExpr("CAST(l_linenumber AS INT) AS station", "CAST(l_quantity AS DOUBLE) AS q", "l_extendedprice AS stage")
    a = p.select("station").distinct().select("station", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("i")).select("station", (F.col("i") + 0.3).alias("q"))
    return rounded(hydrology.rating_curve(p, a, "station"), 3, q=1)


@query("flooded_between", "SELECT sim, count(*) FILTER (depth > 2.3 AND depth < 2.7) * 25.0::DOUBLE AS area FROM raster GROUP BY sim", R)
def _(s, d):
    return ensemble.flooded_between(t.raster(s, d), 25.0, 2.3, 2.7)


@query("exclusive_zone", ", f AS (SELECT cell, avg((depth IS NOT NULL)::INT) FILTER (sim <= 3) AS a, avg((depth IS NOT NULL)::INT) FILTER (sim > 3) AS b FROM raster GROUP BY cell) SELECT cell, round(a, 6) AS wet_a, round(b, 6) AS wet_b, round(b - a, 6) AS difference, CASE WHEN a > 0 AND b = 0 THEN 0 WHEN b > 0 AND a = 0 THEN 1 END AS only FROM f", R)
def _(s, d):
    r = t.raster(s, d)
    return rounded(ensemble.exclusive_zone(r, r.select("sim").distinct().withColumn("regime", (F.col("sim") > 3).cast("int"))), 6)


@query("weighted_roughness", "SELECT l_suppkey AS basin, round(sum(l_quantity * n) / sum(l_quantity), 6) AS roughness FROM lineitem JOIN (VALUES (1, 0.03), (2, 0.05), (3, 0.1), (4, 0.035)) q(c, n) ON c = l_linenumber GROUP BY ALL")
def _(s, d):
    x = t.read(s, d, "lineitem").select(F.col("l_suppkey").alias("basin"), F.col("l_linenumber").alias("code"), F.col("l_quantity").cast("double").alias("area"))
    return rounded(ensemble.weighted_roughness(x, {1: 0.03, 2: 0.05, 3: 0.1, 4: 0.035}, "basin", "code", "area"), 6)


# relational forms: wide tables, aligned pairs, manifests

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]  # the series of the daily table


@query("maxima_wide", "SELECT year(block_end)::INT AS year, " + ", ".join(f"max(value) FILTER (series_id = '{r}') AS {r.lower().replace(' ', '_')}" for r in REGIONS) + " FROM annual GROUP BY 1", D, ANNUAL)
def _(s, d):
    wide = annual(s, d).groupBy(F.year("block_end").alias("year")).pivot("series_id", REGIONS).max("value")
    return wide.toDF(*(c.lower().replace(" ", "_") for c in wide.columns))


@query("pairs_long", ", l AS (SELECT ts::TIMESTAMP AS ts, unnest(['obs', 'sim']) AS variable, unnest([obs, sim]) AS value FROM pairs) SELECT * FROM l", P)
def _(s, d):
    return t.pairs(s, d).unpivot("ts", ["obs", "sim"], "variable", "value")


@query("aligned_pairs", "SELECT ts::TIMESTAMP AS ts, obs, sim FROM pairs WHERE obs IS NOT NULL AND sim > 0", P)
def _(s, d):
    x = t.hourly(s, d).where("value > 0")
    return parsers.align(x.where("series_id = 'click'"), x.where("series_id = 'view'"))


@query("dry_dates", ", w AS (SELECT series_id, ts FROM series WHERE value > 0) SELECT series_id, ts::TIMESTAMP AS ts FROM series EXCEPT SELECT series_id, ts::TIMESTAMP FROM w", D)
def _(s, d):
    x = t.daily(s, d)
    return x.select("series_id", "ts").join(x.where("value > 0").select("series_id", "ts"), ["series_id", "ts"], "left_anti")


# readers over text made from the tables


def _lines(s: SparkSession, body: DataFrame, *head: str) -> DataFrame:
    return s.createDataFrame([(x,) for x in head], "value string").union(body)


@query("rdb_listing", "SELECT s_suppkey::VARCHAR AS site_no, s_name AS station_nm, s_acctbal AS drain_area_va, round(s_acctbal * 2.58999, 4) AS drain_area_km2 FROM supplier")
def _(s, d):
    body = t.read(s, d, "supplier").select(F.concat_ws("\t", F.col("s_suppkey").cast("string"), "s_name", F.col("s_acctbal").cast("string")))
    lines = _lines(s, body, "# listing", "site_no\tstation_nm\tdrain_area_va", "15s\t50s\t8s")
    return rounded(parsers.rdb_rows(lines, ["site_no", "station_nm", "drain_area_va"]), 4)


@query("grdc_listing", "SELECT o_orderdate::DATE AS date, CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END AS discharge FROM orders")
def _(s, d):
    value = F.when(F.col("o_orderkey") % 50 == 0, F.lit("-999.000")).otherwise(F.format_string("%.2f", "o_totalprice"))
    body = t.read(s, d, "orders").select(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("; --:--; "), value))
    return rounded(parsers.grdc_rows(_lines(s, body, "# GRDC-No.: 1", "YYYY-MM-DD;hh:mm; Value")), 2)


@query("nwis_listing", "SELECT ts::DATE AS date, CASE WHEN event_id % 7 <> 0 AND value >= 20 THEN round((value - 20) * 0.028316847, 6) END AS discharge FROM events")
def _(s, d):
    ice = F.when(F.col("event_id") % 7 == 0, F.array(F.lit("P"), F.lit("Ice"))).otherwise(F.array(F.lit("P")))
    one = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("dateTime"), (F.col("value") - 20).cast("string").alias("value"), ice.alias("qualifiers"))
    j = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct(F.array(one).alias("value"))).alias("values"))).alias("timeSeries")).alias("value")))
    return rounded(parsers.nwis_rows(t.read(s, d, "events").select(j.alias("json"))), 6)


@query("channel_table", "SELECT dayofyear(o_orderdate)::INT AS jday, month(o_orderdate)::INT AS mon, day(o_orderdate)::INT AS day, year(o_orderdate)::INT AS yr, 'cha' || o_custkey AS name, o_totalprice AS flo, o_orderkey::DOUBLE AS flo_1, o_orderdate::DATE AS date FROM orders")
def _(s, d):
    c = F.col("o_orderdate")
    body = t.read(s, d, "orders").select(F.concat_ws("  ", F.dayofyear(c).cast("string"), F.month(c).cast("string"), F.day(c).cast("string"), F.year(c).cast("string"), F.concat(F.lit("cha"), F.col("o_custkey").cast("string")), F.format_string("%.2f", "o_totalprice"), F.col("o_orderkey").cast("string")))
    head = "jday mon day yr name flo flo"
    return rounded(parsers.channel_rows(_lines(s, body, "channel output", head, "- - - - - m3/s m3/s"), head), 2)


@query("synop_days", "SELECT ts::DATE AS date, round(sum(CASE WHEN event_id % 5 = 0 THEN 0.1 WHEN event_id % 5 < 4 THEN value END), 5) AS prec, round(avg(CASE WHEN event_id % 17 < 16 THEN event_id % 17 * 22.5 END), 6) AS wind_dir, round(avg(value), 6) AS vel, round(avg(value + 5), 6) AS tmax, round(avg(value - 5), 6) AS tmin FROM events GROUP BY 1")
def _(s, d):
    k = F.col("event_id") % 5
    prec = F.when(k == 0, F.lit(" Ip ")).when(k < 4, F.replace(F.col("value").cast("string"), F.lit("."), F.lit(","))).otherwise(F.lit("--"))
    wind = F.coalesce(F.get(F.array(*map(F.lit, parsers.ROSE)), (F.col("event_id") % 17).cast("int")), F.lit("calm"))
    return rounded(parsers.synop_daily(t.read(s, d, "events").select("ts", prec.alias("prec"), F.lower(wind).alias("wind"), F.col("value").alias("vel"), (F.col("value") + 5).alias("tmax"), (F.col("value") - 5).alias("tmin"))), 6, prec=5)


@query("file_years", "SELECT o_orderkey, year(o_orderdate)::INT AS first, (year(o_orderdate) + o_orderkey % 30)::INT AS last FROM orders")
def _(s, d):
    a, k = F.year("o_orderdate"), F.col("o_orderkey")
    name = F.when(k % 2 == 0, F.format_string("pr_day_%d0101-%d1231.nc", a, a + k % 30)).otherwise(F.format_string("tas_mon_%d-%d.nc", a, a + k % 30))
    first, last = parsers.years_of_name(name)
    return t.read(s, d, "orders").select("o_orderkey", first.alias("first"), last.alias("last"))


@query("plain_names", "SELECT n_nationkey, 'rio_' || replace(lower(n_name), ' ', '_') || '_' || n_nationkey AS name FROM nation")
def _(s, d):
    raw = F.concat(F.lit(" Río  "), F.col("n_name"), F.lit(" ("), F.col("n_nationkey").cast("string"), F.lit(")"))
    return t.read(s, d, "nation").select("n_nationkey", parsers.plain_name(raw).alias("name"))


@query("station_degrees", "SELECT s_suppkey, round((CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END) * (s_suppkey % 90 + s_suppkey % 60 / 60 + s_suppkey * 7 % 60 / 3600), 6) AS lat FROM supplier")
def _(s, d):
    k = F.col("s_suppkey")
    raw = F.concat(F.format_string("%02d%02d%02d", k % 90, k % 60, k * 7 % 60), F.when(k % 2 == 0, F.lit("S")).otherwise(F.lit("n")))
    return rounded(t.read(s, d, "supplier").select("s_suppkey", parsers.dms_degrees(raw).alias("lat")), 6)


@query("fixed_blocks", "SELECT series_id, pos // 10 AS line, string_agg(printf('%8.2f', round(value, 2)), '' ORDER BY pos) AS text FROM series GROUP BY ALL", H)
def _(s, d):
    x = events.with_pos(t.hourly(s, d)).withColumn("value", F.round("value", 2)).withColumn("pos", F.col("pos").cast("long"))
    return parsers.block_lines(x)


@query("normal_depth", "SELECT s_suppkey, round(1.5::DOUBLE + s_suppkey % 500, 4) AS q FROM supplier")
def _(s, d):
    """The discharge that the depth found carries, which must be the one asked for."""
    q = 1.5 + F.col("s_suppkey") % 500
    x = t.read(s, d, "supplier").select("s_suppkey", hydrology.normal_depth(q, F.lit(20.0), F.lit(0.001), F.lit(0.03)).alias("h"))
    area = 20.0 * F.col("h")
    return rounded(x.select("s_suppkey", (area * F.pow(area / (20.0 + 2 * F.col("h")), 2 / 3) * F.sqrt(F.lit(0.001)) / 0.03).alias("q")), 4)
