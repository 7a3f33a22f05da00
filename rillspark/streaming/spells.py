"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wet_spells(stream: DataFrame, threshold: float, step: str = "1 hour", min_gap: int = 1, lateness: str = "6 hours") -> DataFrame:
    """Spells of (series_id, ts TIMESTAMP, value) above threshold, closed by the watermark. A session window whose gap is
    min_gap + 1.5 steps bridges dry gaps of up to min_gap steps. Works on streams and tables alike."""
    n, unit = step.split()
    gap = f"{int((min_gap + 1.5) * int(n) * {'hour': 60, 'day': 1440, 'minute': 1}[unit.rstrip('s')])} minutes"
    wet = stream.withWatermark("ts", lateness).where(F.col("value") > threshold)
    s = wet.groupBy("series_id", F.session_window("ts", gap).alias("w")).agg(F.max("value").alias("peak"), F.sum("value").alias("wet_total"), F.count("*").alias("wet_steps"), F.min("ts").alias("date_start"), F.max("ts").alias("date_end"))
    return s.drop("w")


def block_maxima(stream: DataFrame, block: str = "1 day", lateness: str = "6 hours") -> DataFrame:
    """Maxima of tumbling windows, for a stream with late rows."""
    return stream.withWatermark("ts", lateness).groupBy("series_id", F.window("ts", block).alias("w")).agg(F.max("value").alias("value")).select("series_id", F.col("w.start").alias("block_start"), "value")
