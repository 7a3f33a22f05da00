"""Events of time series (series_id, ts, value): spells, flood events, peaks over threshold, N-day sums.

Every operator handles all series at once; a series is ordered by ts, and pos counts its steps from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _order() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("ts")


def _before() -> WindowSpec:
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def _after() -> WindowSpec:
    return _order().rowsBetween(0, Window.unboundedFollowing)


def with_pos(df: DataFrame) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(_order()) - 1)


def _islands(hits: DataFrame, gap: int) -> DataFrame:
    """Numbers the runs of hits whose positions lie at most gap apart."""
    new = F.when(F.col("pos") - F.lag("pos").over(_order()) <= gap, 0).otherwise(1)
    return hits.withColumn("_new", new).withColumn("island", F.sum("_new").over(_before())).drop("_new")


def wet_spells(df: DataFrame, threshold: float, min_gap: int = 1, min_duration: int = 1) -> DataFrame:
    """Spells above threshold; dry gaps of up to min_gap steps are bridged. (series_id, date_start, date_end, peak,
    total, duration, mean_intensity); total takes the bridged steps in, mean_intensity the wet ones only."""
    s = with_pos(df)
    # values of bridged steps are reached by cumulative sums, so no range join is needed
    s = s.withColumn("cum", F.sum("value").over(_before()))
    wet = _islands(s.where(F.col("value") > threshold), min_gap + 1)
    out = wet.groupBy("series_id", "island").agg(
        F.min("ts").alias("date_start"),
        F.max("ts").alias("date_end"),
        F.max("value").alias("peak"),
        (F.max_by("cum", "pos") - F.min_by(F.col("cum") - F.col("value"), "pos")).alias("total"),
        (F.max("pos") - F.min("pos") + 1).cast("long").alias("duration"),
        F.avg("value").alias("mean_intensity"),
    )
    return out.where(F.col("duration") >= min_duration).drop("island")


def dry_spells(df: DataFrame, threshold: float) -> DataFrame:
    """(series_id, duration, spells): how many runs at or below threshold have each length."""
    runs = _islands(with_pos(df).where(F.col("value") <= threshold), 1).groupBy("series_id", "island").agg(F.count("*").alias("duration"))
    return runs.groupBy("series_id", "duration").agg(F.count("*").alias("spells"))


def _marked(df: DataFrame, threshold: float) -> DataFrame:
    """Rising and falling crossings and local extremes, each by position."""
    s = with_pos(df).withColumn("nxt", F.lead("value").over(_order())).withColumn("prv", F.lag("value").over(_order()))
    s = s.withColumn("n", F.count("*").over(Window.partitionBy("series_id")))
    th = F.lit(threshold)
    s = s.withColumn("rise", (F.col("nxt") > F.col("value")) & (F.col("value") <= th) & (F.col("nxt") > th))
    # the reference point of a fall is the step after it
    s = s.withColumn("fall", (F.col("value") < F.col("prv")) & (F.col("prv") >= th) & (F.col("value") < th))
    s = s.withColumn("low", (F.col("prv") > F.col("value")) & (F.col("nxt") > F.col("value")))
    return s.withColumn("high", (F.col("prv") < F.col("value")) & (F.col("nxt") < F.col("value")))


def _segments(marked: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows of the series between start_pos and end_pos of each event."""
    spans = bounds.withColumn("pos", F.explode(F.sequence("start_pos", "end_pos")))
    return spans.join(marked.select("series_id", "pos", "ts", "value"), ["series_id", "pos"])


def discharge_events(df: DataFrame, threshold: float, peak_threshold: float | None = None) -> DataFrame:
    """Each rising crossing with the first falling one after it, widened to the nearest local minima; events whose peak
    reaches peak_threshold. (series_id, date_start, date_end, peak, mean, duration, volume, date_peak)."""
    m = _marked(df, threshold)
    pos, future = F.col("pos"), _order().rowsBetween(1, Window.unboundedFollowing)
    m = m.withColumn("end_ref", F.min(F.when(F.col("fall"), pos)).over(future)).withColumn("start_low", F.max(F.when(F.col("low"), pos)).over(_before())).withColumn("end_low", F.min(F.when(F.col("low"), pos)).over(_after()))
    ends = m.where("fall").select("series_id", F.col("pos").alias("end_ref"), F.coalesce("end_low", F.least(F.col("n") - 1, pos + 1)).alias("end_pos"))
    starts = m.where("rise AND end_ref IS NOT NULL").select("series_id", "end_ref", pos.alias("ref"), F.coalesce("start_low", F.greatest(F.lit(0), pos - 1)).alias("start_pos"))
    bounds = starts.join(ends, ["series_id", "end_ref"]).select("series_id", "ref", F.col("start_pos").cast("long"), F.col("end_pos").cast("long"))
    out = _segments(m.withColumn("pos", F.col("pos").cast("long")), bounds).groupBy("series_id", "ref").agg(
        F.min("ts").alias("date_start"), F.max("ts").alias("date_end"), F.max("value").alias("peak"), F.avg("value").alias("mean"), (F.max("end_pos") - F.max("start_pos")).alias("duration"), (F.sum("value") * 86400).alias("volume"), F.expr("min_by(ts, struct(-value, pos))").alias("date_peak")
    )
    return out.where(F.col("peak") >= (threshold if peak_threshold is None else peak_threshold)).drop("ref")


def flood_events(df: DataFrame, threshold: float, peak_threshold: float | None = None) -> DataFrame:
    """Runs at or above threshold, from the last local minimum before to the last local maximum within the run's end
    plus one step; integer positions. (series_id, start_pos, end_pos, peak)."""
    m = _marked(df, threshold).withColumn("start_low", F.max(F.when(F.col("low"), F.col("pos"))).over(_before()))
    m = m.withColumn("last_high", F.max(F.when(F.col("high"), F.col("pos"))).over(_order().rowsBetween(Window.unboundedPreceding, 1)))
    runs = _islands(m.where(F.col("value") >= threshold), 1).groupBy("series_id", "island").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.min_by("start_low", "pos").alias("low"), F.max_by("last_high", "pos").alias("high"), F.max("value").alias("peak"))
    out = runs.select("series_id", F.coalesce("low", "a").cast("long").alias("start_pos"), F.coalesce("high", "b").cast("long").alias("end_pos"), "peak")
    return out.where((F.col("peak") >= (threshold if peak_threshold is None else peak_threshold)) & (F.col("end_pos") >= F.col("start_pos")))


def pot_rain_events(df: DataFrame, threshold: float, min_sep: int = 1) -> DataFrame:
    """Clusters of steps above threshold, at most min_sep apart; the first maximum grows to the run of positive values
    around it. (series_id, date_peak, date_start, date_end, peak, total, duration, mean_intensity)."""
    s = with_pos(df)
    peaks = _islands(s.where(F.col("value") > threshold), min_sep).groupBy("series_id", "island").agg(F.expr("min_by(pos, struct(-value, pos))").alias("pos"))
    runs = _islands(s.where("value > 0"), 1).withColumnRenamed("island", "run")
    spans = runs.groupBy("series_id", "run").agg(F.min("ts").alias("date_start"), F.max("ts").alias("date_end"), F.sum("value").alias("total"), F.count("*").alias("duration"), F.avg("value").alias("mean_intensity"))
    hit = peaks.join(runs, ["series_id", "pos"]).select("series_id", "run", F.col("ts").alias("date_peak"), F.col("value").alias("peak"))
    return hit.join(spans, ["series_id", "run"]).drop("run")


def nday_events(df: DataFrame, n_days: int, threshold: float | None = None, min_sep: int | None = None) -> DataFrame:
    """Largest trailing n_days sums above threshold (by default each series' 90th percentile of positive sums), one for
    each cluster. (series_id, date_start, date_end, total, peak, duration)."""
    trail = _order().rowsBetween(1 - n_days, 0)
    s = with_pos(df).withColumn("r", F.when(F.col("pos") >= n_days - 1, F.round(F.sum("value").over(trail), 6)))
    s = s.withColumn("top", F.max("value").over(trail)).withColumn("date_start", F.min("ts").over(trail))
    limit = s.where("r > 0").groupBy("series_id").agg(F.percentile("r", 0.9).alias("limit")) if threshold is None else s.select("series_id").distinct().withColumn("limit", F.lit(threshold))
    hits = _islands(s.join(F.broadcast(limit), "series_id").where("r > limit"), n_days if min_sep is None else min_sep)  # limit has a row for each series
    best = hits.groupBy("series_id", "island").agg(F.expr("min_by(struct(date_start, ts, r, top), struct(-r, pos))").alias("b"))
    return best.select("series_id", F.col("b.date_start").alias("date_start"), F.col("b.ts").alias("date_end"), F.col("b.r").alias("total"), F.col("b.top").alias("peak"), F.lit(n_days).cast("long").alias("duration"))


def concurrent_events(events: DataFrame, df: DataFrame, buffer_days: int = 1) -> DataFrame:
    """For each event (event_id, date_start, date_end) and series: max, mean and total in the window widened by
    buffer_days on both sides. The window is spread over its days, so the join is an equality."""
    days = events.selectExpr("event_id", f"date_start - INTERVAL {buffer_days} DAY AS a", f"date_end + INTERVAL {buffer_days} DAY AS b").withColumn("day", F.explode(F.expr("sequence(to_date(a), to_date(b))")))
    s = df.withColumn("day", F.to_date("ts"))
    met = s.join(days, "day").where("ts BETWEEN a AND b")
    return met.groupBy("event_id", "series_id").agg(F.max("value").alias("max"), F.avg("value").alias("mean"), F.sum("value").alias("total"))


def pot_peaks(df: DataFrame, threshold: float, min_gap: int) -> DataFrame:
    """Declustered local maxima at or above threshold: in order, a peak is new if min_gap steps lie between it and the
    last one kept, else it replaces that one if larger. (series_id, pos, value)."""
    s = with_pos(df).withColumn("p", F.lag("value").over(_order())).withColumn("q", F.lead("value").over(_order()))
    c = s.where((F.col("value") >= threshold) & (F.col("value") >= F.col("p")) & (F.col("value") >= F.col("q"))).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "value"))).alias("c"))
    step = f"""aggregate(c, CAST(array() AS ARRAY<STRUCT<pos: BIGINT, value: DOUBLE>>), (k, x) ->
        CASE WHEN size(k) = 0 OR x.pos - element_at(k, -1).pos >= {min_gap} THEN array_append(k, x)
             WHEN x.value > element_at(k, -1).value THEN array_append(slice(k, 1, size(k) - 1), x) ELSE k END)"""
    return c.select("series_id", F.explode(F.expr(step)).alias("x")).select("series_id", "x.pos", "x.value")


def rolling_sum(df: DataFrame, n: int) -> DataFrame:
    """Trailing sums of n steps, null for the first n - 1."""
    s = with_pos(df).withColumn("r", F.sum("value").over(_order().rowsBetween(1 - n, 0)))
    return s.select("series_id", "ts", F.when(F.col("pos") >= n - 1, F.col("r")).alias("rolling"))


def rolling_max(df: DataFrame, window: int) -> DataFrame:
    """Centred maxima over an odd window, shorter at the ends."""
    return df.select("series_id", "ts", F.max("value").over(_order().rowsBetween(-(window // 2), window // 2)).alias("rolling"))
