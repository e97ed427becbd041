"""Times of a daily schedule: which are due, which is next, whether a result is stale, and the bounds of a morning. All are Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes by which a run may be late, hours after which a result is stale at a start.
MAX_LATE_MINUTES, STALE_HOURS = 90, 3


def all_times(*lists: Sequence[str]) -> Column:
    """The times `HH:MM` of all lists, each once, in order."""
    return F.array_sort(F.array_distinct(F.concat(*[F.array(*map(F.lit, x)).cast("array<string>") for x in lists])))


def due(now: Column, last_run: Column, times: Sequence[str], tz: str, late: int = MAX_LATE_MINUTES) -> Column:
    """array<timestamp>: the scheduled instants since the last run that are past and at most `late` minutes old, oldest first.

    Compared on the UTC line, so hours that a change of the clocks takes or repeats count as they are; a wall time that it skips moves on with it.
    """
    day = F.to_date(F.from_utc_timestamp(now, tz))
    days = F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.date_add(day, i).cast("string"))
    instants = F.flatten(F.transform(days, lambda d: F.array(*[F.to_utc_timestamp(F.to_timestamp(F.concat(d, F.lit(f" {t}:00"))), tz) for t in times]).cast("array<timestamp>")))
    fresh = lambda w: (w <= now) & (w >= now - F.make_interval(mins=F.lit(late))) & F.coalesce(w > last_run, F.lit(True))
    return F.array_sort(F.filter(instants, fresh))


def following(now_local: Column, times: Sequence[str]) -> Column:
    """The next `HH:MM` after a local time: today's first later one, else the day's first; null without times."""
    listed = F.array(*map(F.lit, times)).cast("array<string>")
    at = F.date_format(now_local, "HH:mm")
    return F.coalesce(F.array_min(F.filter(listed, lambda t: t > at)), F.array_min(listed))


def stale(now: Column, generated_at: Column, hours: int = STALE_HOURS) -> Column:
    """True where there is no result, its time can't be read, or it is older than so many hours."""
    at = generated_at.try_cast("timestamp")
    return F.coalesce(F.unix_micros(now) - F.unix_micros(at) > hours * 3_600_000_000, F.lit(True))


def morning(day: Column, sunrise: Column, dawn: Column, start: str, end: str) -> Column:
    """struct(start, end): local bounds of a morning that starts at `sunrise`, `civil_twilight` or a time, else at midnight; an hour long at least."""
    at = lambda t: F.to_timestamp(F.concat(day.cast("string"), F.lit(f" {t}:00")))
    first = {"sunrise": sunrise, "civil_twilight": dawn}.get(start, at(start) if ":" in start else at("00:00"))
    begin, last = F.coalesce(first, at("00:00")), at(end)
    return F.struct(F.when(begin >= last, last - F.expr("interval 1 hour")).otherwise(begin).alias("start"), last.alias("end"))
