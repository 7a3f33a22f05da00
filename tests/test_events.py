"""Literal vectors for the event operators."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from rillspark.operators import events


def series(spark, values, name="a"):
    start = datetime(2010, 1, 1)
    return spark.createDataFrame([(name, start + timedelta(days=k), float(v)) for k, v in enumerate(values)], "series_id string, ts timestamp_ntz, value double")


@pytest.fixture(scope="module")
def discharge(spark):
    v = [5.0] * 300
    for k in range(20):
        v[30 + k] = 5 + 115 * k / 19
        v[50 + k] = 120 - 115 * k / 20
    for k in range(25):
        v[150 + k] = 5 + 195 * k / 24
        v[175 + k] = 200 - 195 * k / 25
    return series(spark, v)


def test_discharge_events(discharge):
    got = sorted(events.discharge_events(discharge, 50.0).collect(), key=lambda r: r.date_start)
    assert [round(r.peak) for r in got] == [120, 200]
    assert all(r.duration > 0 and abs(r.volume - r["mean"] * (r.duration + 1) * 86400) < 1 for r in got)
    assert [round(r.peak) for r in events.discharge_events(discharge, 50.0, 150.0).collect()] == [200]
    assert events.discharge_events(discharge, 300.0).count() == 0


def test_flood_events_end_at_an_apex(discharge):
    got = sorted(events.flood_events(discharge, 50.0).collect(), key=lambda r: r.start_pos)
    assert [round(r.peak) for r in got] == [120, 200]
    assert all(r.start_pos < r.end_pos for r in got)


def test_wet_spells_bridge_gaps(spark):
    s = series(spark, [0, 5, 8, 0, 6, 4, 0, 0, 0, 0])
    one = events.wet_spells(s, 0.0, min_gap=1).collect()
    assert len(one) == 1 and one[0].peak == 8 and one[0].total == 23 and one[0].duration == 5 and one[0].mean_intensity == 23 / 4
    assert events.wet_spells(s, 0.0, min_gap=0).count() == 2


def test_wet_spells_duration(spark):
    v = [0.0] * 200
    v[5:10], v[40:44], v[100] = [1, 5, 12, 8, 2], [0.5, 3, 9, 1], 0.3
    s = series(spark, v)
    assert events.wet_spells(s, 0.0, 1, 1).count() == 3
    two = events.wet_spells(s, 0.0, 1, 2).collect()
    assert len(two) == 2 and max(r.peak for r in two) == 12


def test_pot_peaks(spark):
    got = sorted(events.pot_peaks(series(spark, [0, 5, 7, 0, 6, 0, 8, 0]), 4.0, 2).collect(), key=lambda r: r.pos)
    assert [r.value for r in got] == [7, 6, 8]


def test_pot_and_nday(spark):
    s = series(spark, [0.1] * 5 + [0] * 5 + [5, 10, 8] + [0] * 7)
    got = events.pot_rain_events(s, 1.0, 1).collect()
    assert len(got) == 1 and got[0].peak == 10 and got[0].duration == 3 and got[0].total == 23
    n = events.nday_events(s, 3, threshold=5.0).collect()
    assert len(n) == 1 and n[0].total == 23 and n[0].duration == 3


def test_rolling(spark):
    got = [r.rolling for r in events.rolling_max(series(spark, [1, 5, 2, 4, 1]), 3).orderBy("ts").collect()]
    assert got == [5, 5, 5, 4, 4]
    assert [r.rolling for r in events.rolling_sum(series(spark, [1, 2, 3]), 2).orderBy("ts").collect()] == [None, 3, 5]


def test_empty(spark):
    s = series(spark, [1.0]).where("false")
    for out in (events.wet_spells(s, 0.0), events.discharge_events(s, 1.0), events.pot_peaks(s, 1.0, 2), events.dry_spells(s, 0.0)):
        assert out.count() == 0


def test_streaming_spells_equal_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from rillspark.streaming import spells

    s = series(spark, [0, 5, 8, 0, 6, 4, 0, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0, 0]).withColumn("ts", F.col("ts").cast("timestamp"))
    s.write.parquet(str(tmp_path / "in"))
    batch = {(r.peak, r.wet_total, r.wet_steps) for r in spells.wet_spells(s, 0.0, "1 day").collect()}
    stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
    q = spells.wet_spells(stream, 0.0, "1 day").writeStream.format("memory").queryName("spells").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = {(r.peak, r.wet_total, r.wet_steps) for r in spark.table("spells").collect()}
    assert batch == {(8.0, 23.0, 4), (3.0, 3.0, 1)}
    assert closed <= batch and (8.0, 23.0, 4) in closed
