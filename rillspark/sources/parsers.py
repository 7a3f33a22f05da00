"""Readers of station text, service JSON and coordinates, as column expressions over text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grdc_rows(lines: DataFrame, text: str = "value", key: str | None = None) -> DataFrame:
    """(key, date, discharge) of the data lines ``YYYY-MM-DD; hh:mm; value``: comments and bad dates are dropped, bad
    values and those below -990 are null."""
    parts = F.split(F.col(text), ";")
    d = lines.where(~F.col(text).startswith("#")).where(F.size(parts) >= 3)
    value = F.trim(parts[2]).try_cast("double")
    out = d.select(*([key] if key else []), F.trim(parts[0]).try_cast("date").alias("date"), F.when(value >= -990, value).alias("discharge"))
    return out.where("date IS NOT NULL")


def grdc_header(lines: DataFrame, text: str = "value") -> DataFrame:
    """(name, content) of the comment lines ``# name: content``."""
    return lines.select(F.trim(F.regexp_extract(text, r"^#\s*([^:]+):", 1)).alias("name"), F.trim(F.regexp_extract(text, r"^#\s*[^:]+:\s*(.*)$", 1)).alias("content")).where("name <> ''")


NWIS = "value STRUCT<timeSeries: ARRAY<STRUCT<values: ARRAY<STRUCT<value: ARRAY<STRUCT<dateTime: STRING, value: STRING, qualifiers: ARRAY<STRING>>>>>>>>"


def nwis_rows(payloads: DataFrame, json: str = "json", unit: float = 0.028316847) -> DataFrame:
    """(date, discharge) in cubic metres: negative values and those under ice are null, others that are no number go."""
    s = payloads.select(F.from_json(json, NWIS).alias("j")).select(F.explode("j.value.timeSeries").alias("t")).select(F.explode("t.values").alias("v")).select(F.explode("v.value").alias("x"))
    value = F.col("x.value").try_cast("double")
    return s.where(value.isNotNull()).select(F.to_date(F.substring("x.dateTime", 1, 10)).alias("date"), F.when((value >= 0) & ~F.array_contains(F.coalesce("x.qualifiers", F.array().cast("array<string>")), "Ice"), value * unit).alias("discharge"))


def dms_degrees(c: Column) -> Column:
    """Degrees of ``DDMMSSH`` or ``DDDMMSSH`` with hemisphere N, S, E, W or O, or of a decimal; else null."""
    t = F.upper(F.trim(c))
    digits = F.regexp_extract(t, r"^(\d{6,7})([NSEWO])$", 1)
    head = F.length(digits) - 4
    deg = F.substring(digits, F.lit(1), head).try_cast("double") + F.substring(digits, head + 1, F.lit(2)).try_cast("double") / 60 + F.substring(digits, head + 3, F.lit(2)).try_cast("double") / 3600
    sign = F.when(F.right(t, F.lit(1)).isin("S", "W", "O"), -1).otherwise(1)
    return F.when(digits != "", sign * deg).otherwise(F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))


# fixed values: the sixteen points of the compass
ROSE = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def rose_degrees(c: Column) -> Column:
    """Degrees of a compass point; calm and unknown are null."""
    at = F.array_position(F.array(*map(F.lit, ROSE)), F.upper(F.trim(c)))
    return F.when(at > 0, (at - 1) * 22.5)


def years_of_name(c: Column) -> tuple[Column, Column]:
    """First and last year in a file name, ``_YYYYMMDD-YYYYMMDD`` before ``_YYYY-YYYY``; null without."""
    long, short = r"_(\d{4})\d{2,4}-(\d{4})\d{2,4}", r"_(\d{4})-(\d{4})"
    pick = lambda k: F.coalesce(F.nullif(F.regexp_extract(c, long, k), F.lit("")), F.nullif(F.regexp_extract(c, short, k), F.lit(""))).cast("int")
    return pick(1), pick(2)


def plain_name(c: Column) -> Column:
    """A file name of ASCII letters, digits and underscores."""
    folded = F.translate(F.lower(c), "áàäâãéèëêíìïîóòöôõúùüûñç", "aaaaaeeeeiiiiooooouuuunc")
    out = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", F.lit("station")).otherwise(out)


def complete_combinations(rows: DataFrame, keys: list[str], item: str, wanted: list[str]) -> DataFrame:
    """The keys that have every wanted item."""
    return rows.where(F.col(item).isin(wanted)).groupBy(*keys).agg(F.count_distinct(item).alias("n")).where(F.col("n") == len(set(wanted))).select(*keys)


def trace_amount(c: Column) -> Column:
    """Precipitation text: the mark of a trace is 0.1, other text that is no number null."""
    t = F.lower(F.trim(c))
    return F.when(t == "ip", 0.1).otherwise(F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))


def align(obs: DataFrame, sim: DataFrame) -> DataFrame:
    """(ts, obs, sim) on common times of two (ts, value) tables, nulls dropped."""
    return obs.where("value IS NOT NULL").select("ts", F.col("value").alias("obs")).join(sim.where("value IS NOT NULL").select("ts", F.col("value").alias("sim")), "ts")


def rdb_rows(lines: DataFrame, columns: list[str], text: str = "value") -> DataFrame:
    """Rows of a tab-separated station listing: comments, the header and the row of formats are skipped; drainage areas
    in square miles get a column in square kilometres."""
    parts = F.split(F.col(text), "\t")
    d = lines.where(~F.col(text).startswith("#") & (F.col(text) != "")).where((parts[0] != columns[0]) & ~parts[0].rlike(r"^\d+s$"))
    out = d.select(*(F.trim(F.get(parts, F.lit(k))).alias(c) for k, c in enumerate(columns)))
    for c in columns:
        if c.endswith("_va"):
            out = out.withColumn(c, F.col(c).try_cast("double"))
    if "drain_area_va" in columns:
        out = out.withColumn("drain_area_km2", F.col("drain_area_va") * 2.58999)
    return out


def unique_names(header: str) -> list[str]:
    """Names of a white-space header; a name that occurs again gets a number."""
    seen: dict[str, int] = {}
    out = []
    for n in header.split():
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}_{k}" if k else n)
    return out


def channel_rows(lines: DataFrame, header: str, freq: str = "day", text: str = "value") -> DataFrame:
    """Rows of a channel output table below its header and unit lines; date from year and day of year (``day``), at the
    month's end (``month``) or the year's end (``year``)."""
    names = unique_names(header)
    parts = F.split(F.trim(F.col(text)), r"\s+")
    d = lines.where(parts[0].rlike(r"^\d+$")).select(*(F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)))
    d = d.select(*(F.col(n) if n == "name" else F.col(n).try_cast("int").alias(n) if n in ("jday", "mon", "day", "yr", "unit") else F.col(n).try_cast("double").alias(n) for n in names))
    date = {"day": F.expr("date_add(make_date(yr, 1, 1), jday - 1)"), "month": F.expr("last_day(make_date(yr, mon, 1))"), "year": F.expr("make_date(yr, 12, 31)")}
    if freq not in date:
        raise ValueError(f"freq must be one of {sorted(date)}")
    return d.withColumn("date", date[freq])


def station_rows(table: DataFrame, time: str = "time") -> DataFrame:
    """(series_id, ts, value) of a wide table with a column for each station; of repeated times the first value by order
    of appearance is not known to a table, so the smallest is kept."""
    names = [c for c in table.columns if c != time]
    long = table.unpivot([time], names, "series_id", "value").where("value IS NOT NULL")
    return long.groupBy("series_id", F.col(time).cast("timestamp_ntz").alias("ts")).agg(F.min("value").alias("value"))


def synop_daily(rows: DataFrame) -> DataFrame:
    """One row for each day of (ts, prec text, wind text, vel, tmax, tmin): precipitation is summed, null if it has none;
    the others are averaged, wind directions as degrees."""
    d = rows.select(F.to_date("ts").alias("date"), trace_amount(F.col("prec")).alias("prec"), rose_degrees(F.col("wind")).alias("wind_dir"), "vel", "tmax", "tmin")
    return d.groupBy("date").agg(F.sum("prec").alias("prec"), F.avg("wind_dir").alias("wind_dir"), F.avg("vel").alias("vel"), F.avg("tmax").alias("tmax"), F.avg("tmin").alias("tmin"))


def block_lines(series: DataFrame, per_line: int = 10, form: str = "%8.2f") -> DataFrame:
    """(series_id, line, text): fixed-width blocks of values in order of pos, per_line to a line."""
    d = series.withColumn("line", F.expr(f"pos div {per_line}"))
    return d.groupBy("series_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: F.format_string(form, x["value"])), "").alias("text"))
