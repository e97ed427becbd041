"""Hours, seasons, overlaps and the sun as Column expressions. Timestamps are UTC instants; local wall clocks come from a zone name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zenith angles of sunrise and of civil twilight.
SUNRISE, CIVIL = 90.833, 96.0


def hour_spine(start: Column, end: Column, hours: int = 1) -> Column:
    """array<timestamp>: whole steps from `start` to before `end`, laid out on the UTC line, so clock changes neither skip nor repeat one."""
    step = F.expr(f"interval {hours} hours")
    return F.when(start < end, F.filter(F.sequence(start, end, step), lambda t: t < end)).otherwise(F.array().cast("array<timestamp>"))


def with_spine(df: DataFrame, ts: str, keys: list[str], hours: int = 1) -> DataFrame:
    """One row for each key and hour between the key's first and last hour: keys, hour."""
    unit = F.date_trunc("hour", F.col(ts))
    spans = df.groupBy(*keys).agg(F.min(unit).alias("a"), F.max(unit).alias("b"))
    return spans.select(*keys, F.explode(hour_spine(F.col("a"), F.col("b") + F.expr("interval 1 second"), hours)).alias("hour"))


def overlap_fraction(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Share of [start, end) that lies in [low, high); 0 if a bound is null or the span is empty."""
    secs = lambda a: F.unix_micros(a).cast("double")
    inside = F.greatest(F.lit(0.0), F.least(secs(end), secs(high)) - F.greatest(secs(start), secs(low)))
    ok = start.isNotNull() & end.isNotNull() & low.isNotNull() & high.isNotNull() & (end > start)
    return F.when(ok, inside / (secs(end) - secs(start))).otherwise(F.lit(0.0))


def in_season(day: Column, start: str, end: str) -> Column:
    """Whether the month and day lie in [start, end] (MM-dd); a season that ends before it starts runs over the new year."""
    d = F.date_format(day, "MM-dd")
    return (d >= start) & (d <= end) if start <= end else (d >= start) | (d <= end)


def fresh(at: Column, now: Column, minutes: int) -> Column:
    """Within `minutes` before or after `now`; false for null."""
    return F.coalesce(F.abs(F.unix_micros(at) - F.unix_micros(now)) <= minutes * 60_000_000, F.lit(False))


def target_date(now_local: Column, morning_end: str) -> Column:
    """Today until the morning's end (HH:mm), then tomorrow."""
    return F.when(F.date_format(now_local, "HH:mm") >= morning_end, F.date_add(now_local.cast("date"), 1)).otherwise(now_local.cast("date"))


def _sun(day: Column, minutes: Column) -> tuple[Column, Column]:
    """(declination in degrees, equation of time in minutes) at so many minutes after midnight UTC, by NOAA's published formulas."""
    t = (F.datediff(day, F.lit("2000-01-01")) - 0.5 + minutes / 1440.0) / 36525.0
    l0 = F.radians(F.pmod(280.46646 + t * (36000.76983 + t * 0.0003032), F.lit(360.0)))
    m = F.radians(357.52911 + t * (35999.05029 - 0.0001537 * t))
    e = 0.016708634 - t * (0.000042037 + 0.0000001267 * t)
    centre = F.sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + F.sin(2 * m) * (0.019993 - 0.000101 * t) + F.sin(3 * m) * 0.000289
    node = F.radians(125.04 - 1934.136 * t)
    seen = F.radians(F.degrees(l0) + centre - 0.00569 - 0.00478 * F.sin(node))
    mean_tilt = 23.0 + (26.0 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60.0) / 60.0
    tilt = F.radians(mean_tilt + 0.00256 * F.cos(node))
    y = F.pow(F.tan(tilt / 2), 2)
    equation = y * F.sin(2 * l0) - 2 * e * F.sin(m) + 4 * e * y * F.sin(m) * F.cos(2 * l0) - 0.5 * y * y * F.sin(4 * l0) - 1.25 * e * e * F.sin(2 * m)
    return F.degrees(F.asin(F.sin(tilt) * F.sin(seen))), 4 * F.degrees(equation)


def sun_event(day: Column, lat: Column, lon: Column, rising: bool, zenith: float = SUNRISE) -> Column:
    """UTC instant at which the sun passes `zenith` on the date, refined once; null where it does not."""
    minutes = F.lit(720.0) - 4.0 * lon
    for _ in range(2):
        declination, equation = _sun(day, minutes)
        d = F.radians(declination)
        cosine = F.cos(F.radians(F.lit(zenith))) / (F.cos(F.radians(lat)) * F.cos(d)) - F.tan(F.radians(lat)) * F.tan(d)
        angle = F.when(F.abs(cosine) <= 1, F.degrees(F.acos(cosine)))
        minutes = 720.0 - 4.0 * (lon + (angle if rising else -angle)) - equation
    return F.timestamp_micros((F.unix_micros(day.cast("timestamp")) + F.round(minutes * 60_000_000)).cast("long"))
