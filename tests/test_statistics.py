"""Extremes, bias correction, skill, space, ensembles, dependence and parsers against literal values."""

from __future__ import annotations

import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.functions import distributions as dist
from rillspark.operators import bias, copulas, ensemble, extremes, hydrology, regional, skill, spatial
from rillspark.sources import parsers

SERIES = "series_id string, ts timestamp_ntz, value double"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_block_maxima(spark):
    rows = [("2000-01-01", 1), ("2000-06-01", 7), ("2000-12-31", 3), ("2001-01-01", 2), ("2001-02-01", 9), ("2001-12-31", 4)]
    s = spark.createDataFrame([("a", datetime.fromisoformat(d), float(v)) for d, v in rows], SERIES)
    got = extremes.block_maxima(s).orderBy("block_end").collect()
    assert [(r.block_end, r.value) for r in got] == [(date(2000, 12, 31), 7), (date(2001, 12, 31), 9)]
    with pytest.raises(ValueError):
        extremes.block_maxima(s, "week")


def test_levels(spark):
    assert value(spark, dist.gev_level(50, F.lit(10.0), F.lit(2.0), F.lit(0.0))) == pytest.approx(10 - 2 * math.log(-math.log(0.98)))
    assert value(spark, dist.gpd_level(10, F.lit(2.0), F.lit(0.0), F.lit(3.0), F.lit(1.5))) == pytest.approx(3 + 2 * math.log(15))
    q = dist.gev_quantile(0.9, F.lit(5.0), F.lit(2.0), F.lit(0.2))
    assert value(spark, dist.gev_cdf(q, F.lit(5.0), F.lit(2.0), F.lit(0.2))) == pytest.approx(0.9)
    for x in (0.7, 1.0, 2.5, 6.0):
        assert value(spark, dist.gamma(F.lit(x))) == pytest.approx(math.gamma(x), rel=1e-12)


def test_mle_recovers(spark):
    g = np.random.default_rng(1)
    u = g.uniform(size=800)
    x = 100 + 20 / 0.1 * ((-np.log(u)) ** -0.1 - 1)
    s = spark.createDataFrame([("a", float(v)) for v in x], "series_id string, value double")
    r = extremes.gev_mle(s).first()
    assert r.mu == pytest.approx(100, abs=3) and r.sigma == pytest.approx(20, abs=2.5) and r.xi == pytest.approx(0.1, abs=0.08)
    m = extremes.gev_from_lmoments(extremes.lmoments(s, "series_id")).first()
    assert m.xi == pytest.approx(0.1, abs=0.1)


def test_regional(spark):
    rows = [(k, v) for k, vs in (("A", [10, 20, 30]), ("B", [5, 10, 15])) for v in vs]
    d = spark.createDataFrame([(k, i, float(v)) for i, (k, v) in enumerate(rows)], "station string, year int, value double")
    got = {(r.station, r.value): (r.index_flood, r.normalised) for r in regional.index_flood(d).collect()}
    assert got["A", 10.0] == (20, 0.5) and got["B", 15.0] == (10, 1.5)


def test_discordancy_sums_to_sites(spark):
    g = np.random.default_rng(0)
    rows = [(f"s{k}", y, float(1000 + 300 / 0.15 * ((-math.log(g.uniform())) ** -0.15 - 1))) for k in range(8) for y in range(35)]
    rows += [("odd", y, float(1000 + (y % 7 == 0) * 90000 + y)) for y in range(35)]
    got = regional.discordancy(spark.createDataFrame(rows, "station string, year int, value double")).collect()
    assert sum(r.d for r in got) == pytest.approx(9)
    assert max(got, key=lambda r: r.d).station == "odd" and next(r for r in got if r.station == "odd").discordant


def test_quantile_mapping_against_numpy(spark):
    g = np.random.default_rng(42)
    obs, sce = g.gamma(2, 2, 500), g.gamma(2, 2, 300) + 5
    mod = obs[:400] + 5
    frame = lambda v: spark.createDataFrame([("a", datetime(2000, 1, 1) + timedelta(days=i), float(x)) for i, x in enumerate(v)], SERIES)
    got = [r.corrected for r in bias.quantile_mapping(frame(obs), frame(mod), frame(sce)).orderBy("ts").collect()]
    p = np.searchsorted(np.sort(mod), sce, side="right") / len(mod)
    want = np.maximum(sce + np.quantile(obs, p) - np.quantile(mod, p), 0)
    assert len(got) == 300 and np.allclose(got, want)
    assert abs(np.mean(got) - obs.mean()) < abs(sce.mean() - obs.mean())


def test_skill(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0), ("a", None, 99.0), ("a", 3.0, 3.0), ("a", 4.0, 5.0), ("b", 2.0, 2.0), ("b", 2.0, 3.0)], "series_id string, obs double, sim double")
    got = {r.series_id: r for r in skill.skill(d).collect()}
    o = np.array([1, 3, 4.0])
    assert got["a"].nse == pytest.approx(1 - 1 / ((o - o.mean()) ** 2).sum()) and got["a"].pbias == pytest.approx(12.5)
    assert got["b"].nse is None and got["b"].kge is None


def test_space(spark):
    st = spark.createDataFrame([(1, 0.0, 0.0, 10.0), (2, 3.0, 4.0, 20.0)], "station long, x double, y double, value double")
    cells = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 0.0)], "cell long, x double, y double")
    got = {r.cell: r.value for r in spatial.idw(cells, st).collect()}
    assert got[0] == 10 and got[1] == pytest.approx((10 / 9 + 20 / 16) / (1 / 9 + 1 / 16))
    assert {r.cell: r.value for r in spatial.idw(cells, st.hint("merge")).collect()} == got
    blocks = spatial.against_all(cells, st.selectExpr("station", "x sx", "y sy"), small=1)
    assert blocks.count() == 4
    w = spatial.knn_weights(cells, st, 2).groupBy("cell").agg(F.sum("weight").alias("w")).collect()
    assert all(r.w == pytest.approx(1) for r in w)


def test_soil(spark):
    cases = [(93, 5, 2, 5), (80, 12, 8, 4), (60, 25, 15, 8), (40, 40, 20, 3), (20, 65, 15, 12), (10, 85, 5, 9), (30, 25, 45, 1), (5, 50, 45, 10), (50, 10, 40, 6), (35, 35, 30, 2), (10, 60, 30, 11), (255, 5, 5, 0)]
    got = ensemble.soil_texture(spark.createDataFrame(cases, "sand int, silt int, clay int, want int")).collect()
    assert [r.texture for r in got] == [r.want for r in got]


def test_pixel_return_period(spark):
    d = spark.createDataFrame([(1, float(v)) for v in range(10)], "cell int, depth double")
    got = {r.period: r.depth for r in ensemble.pixel_return_period(d, 1.0, (2, 5, 1000)).collect()}
    assert got == {2: 4.0, 5: 7.0, 1000: 9.0}


def test_copula_samples(spark):
    for family, theta, tau in (("gumbel", 2.0, 0.5), ("clayton", 2.0, 0.5), ("gaussian", 0.7, 2 / math.pi * math.asin(0.7))):
        d = copulas.sample(spark, family, theta, 3000).selectExpr("'a' g", "u[0] x", "u[1] y")
        r = copulas.kendall(d, "x", "y", "g").first()
        assert r.tau == pytest.approx(tau, abs=0.04) and r.n == 3000
        assert d.agg(F.avg("x")).first()[0] == pytest.approx(0.5, abs=0.03)
    a, b = copulas.sample(spark, "frank", 5.0, 6000), copulas.sample(spark, "frank", 5.0, 6000).repartition(7)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_storms(spark):
    d = spark.createDataFrame([("a", float(h), float(h**0.5)) for h in range(1, 6)], "k string, duration double, depth double")
    got = hydrology.alternating_blocks(d, "k").orderBy("slot").collect()
    assert [r.slot for r in got] == [1, 2, 3, 4, 5] and max(got, key=lambda r: r.block).slot == 3
    q = hydrology.normal_depth(F.lit(50.0), F.lit(20.0), F.lit(0.001), F.lit(0.03))
    h = value(spark, q)
    assert 20 * h * (20 * h / (20 + 2 * h)) ** (2 / 3) * 0.001**0.5 / 0.03 == pytest.approx(50, rel=1e-6)
    assert value(spark, hydrology.normal_depth(F.lit(0.5), F.lit(20.0), F.lit(0.001), F.lit(0.03))) == 0.05


def test_parsers(spark):
    js = '{"value":{"timeSeries":[{"values":[{"value":[{"dateTime":"2020-01-01T00:00","value":"10","qualifiers":["A"]},{"dateTime":"2020-01-02T00:00","value":"-5","qualifiers":["A"]},{"dateTime":"2020-01-03T00:00","value":"7","qualifiers":["Ice"]},{"dateTime":"2020-01-04T00:00","value":"bad","qualifiers":[]}]}]}]}}'
    got = parsers.nwis_rows(spark.createDataFrame([(js,)], "json string")).orderBy("date").collect()
    assert [(r.date.day, r.discharge and round(r.discharge, 6)) for r in got] == [(1, round(10 * 0.028316847, 6)), (2, None), (3, None)]
    names = spark.createDataFrame([("pr_x_20150101-21001231.nc",), ("tas_1980-2000",), ("none",)], "n string")
    a, b = parsers.years_of_name(F.col("n"))
    assert [(r.a, r.b) for r in names.select(a.alias("a"), b.alias("b")).collect()] == [(2015, 2100), (1980, 2000), (None, None)]
    assert value(spark, parsers.plain_name(F.lit("Río Añés (2)"))) == "rio_anes_2"
    assert value(spark, parsers.trace_amount(F.lit("ip"))) == 0.1


def test_special_functions():
    from rillspark.functions import special

    x = np.array([0.1, 1.0, 3.0, 10.0])
    assert np.allclose(special.gamma_cdf(x, 1.0), 1 - np.exp(-x))
    assert np.allclose(special.gamma_cdf(x, 2.0), 1 - np.exp(-x) * (1 + x))
    for a in (0.4, 2.0, 15.0):
        assert np.allclose(special.gamma_cdf(special.gamma_ppf(np.array([0.05, 0.5, 0.99]), a), a), [0.05, 0.5, 0.99])
    k, s = special.gamma_mle(np.random.default_rng(0).gamma(3.0, 2.0, 20000))
    assert k == pytest.approx(3, abs=0.15) and s == pytest.approx(2, abs=0.12)


def test_scaled_distribution_mapping(spark):
    g = np.random.default_rng(7)
    frame = lambda v: spark.createDataFrame([("a", datetime(2000, 1, 1) + timedelta(days=i), float(x)) for i, x in enumerate(v)], SERIES)
    obs, hist = g.normal(10, 2, 600), g.normal(12, 3, 600)
    future = g.normal(15, 3, 600)
    got = np.array([r.corrected for r in bias.correct(frame(obs), frame(hist), frame(future), "sdm").orderBy("ts").collect()])
    assert len(got) == 600 and got.mean() == pytest.approx(10 + 3 * 2 / 3, abs=0.5) and np.corrcoef(got, future)[0, 1] > 0.98
    wet = [g.exponential(m, 500) * (g.uniform(size=500) < 0.6) for m in (3, 3, 5)]
    rain = np.array([r.corrected for r in bias.correct(*map(frame, wet), "sdm", "precipitation").orderBy("ts").collect()])
    assert (rain >= 0).all() and rain[rain > 0].mean() == pytest.approx(5, rel=0.25)
    with pytest.raises(ValueError):
        bias.correct(*map(frame, wet), "none")
    with pytest.raises(NotImplementedError):
        bias.correct(*map(frame, wet), "sdm", "wind")


def test_design(spark):
    from rillspark.operators import design

    g = np.random.default_rng(20260803)
    x = np.exp(0.5 * g.standard_normal((300, 3)))
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>")
    order = design.maxdiss(d, 6)
    want = [int(np.argmax((x**2).sum(1)))]
    while len(want) < 6:
        want.append(int(np.argmax(np.min(((x[:, None] - x[want]) ** 2).sum(-1), axis=1))))
    assert order == want and design.maxdiss(d, 3) == order[:3]
    w = {r.row_id: r.weight for r in design.design_weights(d, order).collect()}
    assert sum(w.values()) == 300 and set(w) == set(order)
    smooth = design.propagate(d, lambda v: v[:, 0] + 0.5 * v[:, 1], 80)
    noise = design.propagate(d, lambda v: np.random.default_rng(1).standard_normal(len(v)), 80)
    assert smooth.strategy == "emulate" and noise.strategy == "monte_carlo" and smooth.runs <= 80 >= noise.runs
    z = np.array([r.features for r in design.standardize(d).orderBy("row_id").collect()])
    truth = z[:, 0] + 0.5 * z[:, 1]
    assert smooth.quantile == pytest.approx(np.quantile(truth, 0.9), rel=0.15)
    trace = design.sequential_design(z[:60], truth[:60])
    assert trace[0][2] == "initial" and {s for _, _, s in trace} <= {"initial", "improving", "converged", "deteriorating"}


def test_kernels_over_space_and_time(spark):
    from rillspark.operators import fields

    st = [(i, float(x), float(y), float(x + 2 * y)) for i, (x, y) in enumerate((a * 10, b * 10) for a in range(6) for b in range(6))]
    stations = spark.createDataFrame(st, "station long, x double, y double, value double")
    cells = spark.createDataFrame([(0, 25.0, 25.0), (1, 20.0, 30.0)], "cell long, x double, y double")
    k = {r.cell: r for r in fields.kriging(cells, stations).collect()}
    assert k[0].value == pytest.approx(75, abs=4) and k[1].value == pytest.approx(80, abs=1e-3)
    gp = {r.cell: r for r in fields.gaussian_process(cells, stations, noise=1e-4).collect()}
    assert gp[0].mean == pytest.approx(75, abs=3) and gp[1].std < gp[0].std + 1e-6
    a, b = fields.nsrp(spark, 30, 0.5, 4, 2, 2, 1.0), fields.nsrp(spark, 30, 0.5, 4, 2, 2, 1.0)
    rain = {r.hour: r.value for r in a.collect()}
    assert len(rain) == 720 and min(rain.values()) == 0 and max(rain.values()) > 0
    assert all(rain[r.hour] == pytest.approx(r.value) for r in b.repartition(3).collect())
    seg = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 2.0, 4.0])] + [("b", 0, 0.0)], "event_id string, pos int, value double")
    got = {r.event_id: r.features for r in fields.resampled(seg, 5).collect()}
    assert got == {"a": [0, 0.25, 0.5, 0.75, 1.0], "b": [0.0] * 5}


def test_station_tables(spark):
    lines = spark.createDataFrame([("# note",), ("site_no\tstation_nm\tdrain_area_va",), ("5s\t15s\t30s",), ("01\tRiver at A\t100",)], "value string")
    r = parsers.rdb_rows(lines, ["site_no", "station_nm", "drain_area_va"]).collect()
    assert len(r) == 1 and r[0].station_nm == "River at A" and r[0].drain_area_km2 == pytest.approx(258.999)
    header = "jday mon day yr unit name flo_stor null flo_out null"
    assert parsers.unique_names(header)[-1] == "null_1"
    rows = spark.createDataFrame([("title",), (header,), ("  32 2 1 2001 4 cha4 1.0 0 2.5 0",)], "value string")
    assert parsers.channel_rows(rows, header).first().date == date(2001, 2, 1)
    assert parsers.channel_rows(rows, header, "month").first().date == date(2001, 2, 28)
    with pytest.raises(ValueError):
        parsers.channel_rows(rows, header, "week")
    syn = spark.createDataFrame([(datetime(2020, 1, 1, 6), "ip", "N", 2.0, 5.0, 1.0), (datetime(2020, 1, 1, 18), "1,4", "E", 4.0, 7.0, None)], "ts timestamp_ntz, prec string, wind string, vel double, tmax double, tmin double")
    d = parsers.synop_daily(syn).first()
    assert (d.prec, d.wind_dir, d.vel, d.tmin) == (1.5, 45.0, 3.0, 1.0)
    wide = spark.createDataFrame([(datetime(2020, 1, 1), 1.0, None), (datetime(2020, 1, 2), 2.0, 3.0), (datetime(2020, 1, 2), 9.0, 3.0)], "time timestamp_ntz, a double, b double")
    assert {(r.series_id, r.ts.day, r.value) for r in parsers.station_rows(wide).collect()} == {("a", 1, 1.0), ("a", 2, 2.0), ("b", 2, 3.0)}
    s = spark.createDataFrame([("a", k, k + 0.5) for k in range(12)], "series_id string, pos int, value double")
    t = {r.line: r.text for r in parsers.block_lines(s).collect()}
    assert len(t[0]) == 80 and t[1] == "   10.50   11.50"


def test_frank_samples_of_negative_dependence(spark):
    from rillspark.operators import copulas

    u = np.array([r.u for r in copulas.sample(spark, "frank", -5.0, 4000).collect()])
    assert abs(u.mean(0) - 0.5).max() < 0.03 and np.corrcoef(u.T)[0, 1] < -0.5
