"""Steps, reservoirs, rating curves and tests of means against plain loops, with odd input."""

from __future__ import annotations

import datetime as dt
import math

from rillspark.operators import ensemble, hydrology, series

T0 = dt.datetime(2020, 1, 1)


def _hours(spark, rows):
    return spark.createDataFrame([(k, T0 + dt.timedelta(hours=h), v) for k, h, v in rows], "series_id string, ts timestamp_ntz, value double")


def test_linear_reservoir_is_the_recursion(spark):
    flow = [3.0, 0.0, 0.0, 10.0, None, 1.0, 0.0] * 20
    got = hydrology.linear_reservoir(_hours(spark, [("a", i, v) for i, v in enumerate(flow)]), 0.7).orderBy("ts").collect()
    q = 0.0
    for r, v in zip(got, flow, strict=True):
        q = 0.7 * (v or 0.0) + (1 - 0.7) * q
        assert math.isclose(r["flow"], q, rel_tol=1e-9, abs_tol=1e-12)
    whole = hydrology.linear_reservoir(_hours(spark, [("a", 0, 5.0), ("a", 1, 2.0)]), 1.0).orderBy("ts").collect()
    assert [r["flow"] for r in whole] == [5.0, 2.0]


def test_values_at_steps(spark):
    known = _hours(spark, [("a", 2, 10.0), ("a", 6, 30.0), ("a", 4, None), ("a", 6, 50.0)])
    got = series.at_steps(known, _hours(spark, [("a", h, None) for h in (0, 2, 3, 4, 5, 9)] + [("b", 1, None)]).select("series_id", "ts"))
    rows = {(r["series_id"], (r["ts"] - T0).seconds // 3600): (r["nearest"], r["linear"]) for r in got.collect()}
    assert rows == {("a", 0): (10.0, None), ("a", 2): (10.0, 10.0), ("a", 3): (10.0, 17.5), ("a", 4): (10.0, 25.0), ("a", 5): (40.0, 32.5), ("a", 9): (40.0, None), ("b", 1): (None, None)}


def test_rating_curve_is_brute_force(spark):
    points = [("a", float(q), float(q * q % 17)) for q in (1, 2, 4, 4, 8, 16, 32, 64)] + [("a", None, 1.0), ("a", 3.0, None), ("one", 5.0, 2.0)]
    ask = [("a", x) for x in (0.0, 1.0, 3.0, 5.5, 40.0, 100.0, 3.0)] + [("one", 9.0), ("none", 1.0)]
    got = {(r["k"], r["q"]): r["stage"] for r in hydrology.rating_curve(spark.createDataFrame(points, "k string, q double, stage double"), spark.createDataFrame(ask, "k string, q double"), "k").collect()}
    p = {float(q): float(q * q % 17) for q in (1, 2, 4, 8, 16, 32, 64)}
    span = math.log1p(64) - math.log1p(1)
    want = {("one", 9.0): 2.0}
    for x in {x for k, x in ask if k == "a"}:
        near = sorted((abs(math.log1p(x) - math.log1p(q)) / span, q) for q in p)[:3]
        w = [1 / max(d, 1e-12) for d, _ in near]
        want["a", x] = sum(a * p[q] for a, (_, q) in zip(w, near, strict=True)) / sum(w)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_means_and_zones_of_odd_input(spark):
    odd = spark.createDataFrame([(True, 1.0), (True, 1.0), (False, 1.0), (None, 9.0), (True, None)], "flag boolean, v double")
    assert series.two_sample_t(odd, "flag", "v").first()["t"] is None
    assert series.two_sample_t(odd.limit(0), "flag", "v").first()["n_a"] == 0
    cells = spark.createDataFrame([(1, 1, 0.5), (2, 1, None), (1, 2, None), (1, 3, 1.0)], "sim int, cell int, depth double")
    zones = ensemble.exclusive_zone(cells, spark.createDataFrame([(1, 0), (2, 1)], "sim int, regime int"))
    assert {r["cell"]: (r["wet_a"], r["wet_b"], r["only"]) for r in zones.collect()} == {1: (1.0, 0.0, 0), 2: (0.0, None, None), 3: (1.0, None, None)}
    covered = series.well_covered(_hours(spark, [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0), ("b", 1, None)]), 0.8)
    assert [tuple(r) for r in covered.collect()] == [("a", 2, 2)]
