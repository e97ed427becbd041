"""Scores of waters and hours put together: an hour on a water, ranking, confidence, gates, days. Frames are keyed; nothing runs over a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import aero
from tidemark.operators import series

#: Ranks of levels, the wind from which a crosswind counts, and bounds of the confidence table.
FAVORABLE, MARGINAL, UNFAVORABLE = 0, 1, 2
LIGHT_WIND_KT = 3.0
AGREE_KT, DISAGREE_KT = 4, 8
FREEZING_F, LOOKBACK_DAYS = 32, 5


def water_hour(hours: DataFrame, wave_ok: float = 8.0, wave_max: float = 12.0, min_run_ft: float = 2000.0, xwind_max: float = 10.0) -> DataFrame:
    """`hours` (hs_in, run_ft, wind_kt, wind_dir, chord_ft, chord_bearing, has_field) with xwind_kt, level and limiting.

    Waves have a band; a run into the wind that is too short is unfavorable, but where there is no wave field, and the longest axis is long enough
    and its crosswind within the limit, it is marginal, limited by that crosswind. `limiting` is null for favorable hours.
    """
    xwind = F.when(F.col("wind_kt") >= LIGHT_WIND_KT, F.abs(aero.crosswind(F.col("wind_dir"), F.col("wind_kt"), F.col("chord_bearing"))))
    waves = F.when(F.col("hs_in") <= wave_ok, FAVORABLE).when(F.col("hs_in") <= wave_max, MARGINAL).otherwise(UNFAVORABLE)
    axis = ~F.col("has_field") & (F.col("chord_ft") >= min_run_ft) & (F.col("xwind_kt").isNull() | (F.col("xwind_kt") <= xwind_max))
    run = F.when(F.col("run_ft") >= min_run_ft, FAVORABLE).when(axis, MARGINAL).otherwise(UNFAVORABLE)
    out = hours.withColumn("xwind_kt", xwind).withColumn("_waves", waves).withColumn("_run", run).withColumn("level", F.greatest("_waves", "_run"))
    limiting = F.when(F.col("level") == FAVORABLE, None).when(F.col("_waves") == F.col("level"), "waves").when(F.col("_run") == MARGINAL, "xwind_water").otherwise("run")
    return out.withColumn("limiting", limiting).drop("_waves", "_run")


def ranked(hours: DataFrame, keys: list[str], n: int, frozen: Column | None = None) -> DataFrame:
    """The `n` best waters by their worst hour: by level, then distance_nm, then hs_in, then the keys.

    `hours` has level, limiting, hs_in, run_ft, distance_nm. The worst hour has the worst level, the largest waves and the smallest run; a frozen
    water stays in the list, unfavorable for ice. One partial aggregate and a top-n; no water's hours are gathered.
    """
    ice = F.lit(False) if frozen is None else frozen
    worst = F.max_by(F.struct("level", "limiting"), F.struct("level", "hs_in", -F.col("run_ft"), F.coalesce("limiting", F.lit("")))).alias("w")
    per = hours.groupBy(*keys).agg(worst, F.max("hs_in").alias("hs_in"), F.min("run_ft").alias("run_ft"), F.min("distance_nm").alias("distance_nm"), F.bool_or(ice).alias("frozen"))
    per = per.withColumn("level", F.when(F.col("frozen"), UNFAVORABLE).otherwise(F.col("w.level"))).withColumn("limiting", F.when(F.col("frozen"), "ice").otherwise(F.col("w.limiting")))
    return per.drop("w").orderBy("level", "distance_nm", "hs_in", *keys).limit(n)


def with_confidence(rows: DataFrame) -> DataFrame:
    """`rows` (covers, any_cover, agrees: boolean; wind_diff: double; move: int) with confidence and reasons, an array of texts."""
    diff, move = F.col("wind_diff"), F.col("move")
    differ = F.concat(F.lit("NWS and model wind differ by "), F.bround(diff).cast("long").cast("string"), F.lit(" kt"))
    high = F.col("covers") & F.col("agrees") & F.coalesce(diff <= AGREE_KT, F.lit(False)) & F.coalesce(move == 0, F.lit(False))
    far, moved = F.coalesce(diff > DISAGREE_KT, F.lit(False)), F.coalesce(move >= 2, F.lit(False))
    rest = F.array_compact(F.array(
        F.when(~F.col("any_cover"), "no TAF coverage for the window").when(F.col("covers") & ~F.col("agrees"), "TAF and model disagree on ceiling or visibility"),
        F.when(diff.isNull(), "no NWS wind to compare").when(diff > AGREE_KT, differ),
        F.when(move.isNull(), "first run for this morning").when(move == 1, "the outlook moved a level since the last run"),
    ))
    reasons = F.when(far, F.array(differ)).when(moved, F.array(F.lit("the outlook moved two levels since the last run"))).when(high, F.array(F.lit("TAF covers the window and agrees with the model"))).otherwise(rest)
    return rows.withColumn("confidence", F.when(far | moved, "low").when(high, "high").otherwise("medium")).withColumn("reasons", reasons)


def clears_at(hours: DataFrame, keys: list[str], hour: str, bad: str) -> DataFrame:
    """(keys, clears_at): for keys whose first hour is bad, the first hour that is not, or the last hour; null for other keys."""
    out = hours.groupBy(*keys).agg(F.min_by(bad, hour).alias("_first"), F.min(F.when(~F.col(bad), F.col(hour))).alias("_clear"), F.max(hour).alias("_last"))
    return out.select(*keys, F.when(F.col("_first"), F.coalesce("_clear", "_last")).alias("clears_at"))


def ice_gate(days: DataFrame, keys: list[str], today: Column, season: Column) -> DataFrame:
    """(keys, frozen): in season, or a highest temperature (max_f) below freezing on a day (day) of the last few."""
    recent = F.col("day").between(F.date_sub(today, LOOKBACK_DAYS), today) & (F.col("max_f") < FREEZING_F)
    return days.groupBy(*keys).agg(F.coalesce(F.bool_or(recent | season), F.lit(False)).alias("frozen"))


def worst_in(hours: DataFrame, keys: list[str], hour: str, start: str, end: str, *values: str) -> DataFrame:
    """`values` of the worst hour (column level) in [start, end) of each key, the first of equals."""
    inside = hours.where((F.col(hour) >= F.col(start)) & (F.col(hour) < F.col(end)))
    return inside.groupBy(*keys).agg(F.max_by(F.struct("level", hour, *values), F.struct("level", -F.unix_micros(F.col(hour)))).alias("w")).select(*keys, "w.*")


def peak_in(hours: DataFrame, keys: list[str], hour: str, value: str, start: Column, end: Column) -> DataFrame:
    """(keys, peak): the greatest value in [start, end); null for keys without one."""
    return hours.groupBy(*keys).agg(F.max(F.when((F.col(hour) >= start) & (F.col(hour) < end), F.col(value))).alias("peak"))


def whole_hours(start: Column, end: Column, now: Column) -> Column:
    """The whole hours that overlap [start, end) and have not ended by `now`."""
    first = F.date_trunc("hour", start)
    spine = F.when(start < end, F.sequence(first, end, F.expr("interval 1 hour"))).otherwise(F.array().cast("array<timestamp>"))
    return F.filter(spine, lambda h: (h < end) & (h + F.expr("interval 1 hour") > now))


def hour_index(axis: Column, now: Column) -> Column:
    """The place of the hour that holds `now` in an ascending array, held within its ends; null for an empty one."""
    n = F.size(F.filter(axis, lambda h: h <= now))
    return F.when(F.size(axis) > 0, F.greatest(n - 1, F.lit(0)))


def day_blocks(blocks: DataFrame, keys: list[str], start: str, end: str, dusk: Column) -> DataFrame:
    """(keys, day, level, blocks, from, until): each day's best level, its blocks in order, and its earliest longest run of blocks that good, by dusk.

    `blocks` are hourly, or hours of a block: `start` is a whole hour. `dusk` is a column over keys and day.
    """
    by_day = blocks.withColumn("day", F.to_date(start))
    best = by_day.groupBy(*keys, "day").agg(F.min("level").alias("_best"), F.array_sort(F.collect_list(F.struct(F.col(start).alias("start"), F.col("level").alias("level")))).alias("blocks"))
    good = by_day.join(best.select(*keys, "day", "_best"), [*keys, "day"])
    runs = series.longest_run(good, [*keys, "day"], start, F.col("level") <= F.col("_best"))
    out = best.join(runs.select(*keys, "day", F.col("start").alias("from"), F.col("end").alias("_until")), [*keys, "day"], "left")
    until = F.when((F.col("_until") > dusk) & (dusk > F.col("from")), dusk).otherwise(F.col("_until"))
    return out.select(*keys, "day", F.col("_best").alias("level"), "blocks", "from", until.alias("until"))


def lead(windows: DataFrame, hours: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """(keys, kind, level, start): the first window (start, end, score) that ends after `now`, else the best level of the hours (hour, level) left."""
    ahead = windows.where(F.col("end") > now).groupBy(*keys).agg(F.min(F.struct("start", F.col("score").alias("level"))).alias("a"))
    left = hours.where(F.col("hour") + F.expr("interval 1 hour") > now).groupBy(*keys).agg(F.min(F.struct("level", F.col("hour").alias("start"))).alias("b"))
    out = left.join(ahead, keys, "full_outer")
    return out.select(*keys, F.when(F.col("a").isNotNull(), "window").otherwise("best").alias("kind"), F.coalesce("a.level", "b.level").alias("level"), F.coalesce("a.start", "b.start").alias("start"))


def sampled_periods(hours: DataFrame, periods: DataFrame, keys: list[str], hour: str, values: dict[str, str], bucket_hours: float = 6) -> DataFrame:
    """(keys, hour, each of `values`) for hours that a period of the same keys covers at half past.

    `periods` has start, end, ord, overlay (boolean) and the values. Of those that are no overlays the last (by ord) prevails; without one the first
    overlay stands in. Overlays then make a value worse: `values` says how for each, `min` or `max`. Partial aggregates only.
    """
    width = max(1, round(bucket_hours * 3600))
    bucket = lambda c: F.floor(F.unix_seconds(c) / width)
    at = hours.select(*keys, hour).distinct().withColumn("_t", F.col(hour) + F.expr("interval 30 minutes")).withColumn("_b", bucket(F.col("_t")))
    posted = periods.select(*keys, "start", "end", "ord", "overlay", *values).withColumn("_b", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))
    met = at.join(posted, [*keys, "_b"]).where((F.col("_t") >= F.col("start")) & (F.col("_t") < F.col("end")))
    base = F.max_by(F.struct(*values), F.struct(~F.col("overlay"), F.when(F.col("overlay"), -F.col("ord")).otherwise(F.col("ord")))).alias("_base")
    worst = [(F.min if how == "min" else F.max)(F.when(F.col("overlay"), F.col(v))).alias(f"_{v}") for v, how in values.items()]
    found = met.groupBy(*keys, hour).agg(base, *worst)
    return found.select(*keys, hour, *[(F.least if how == "min" else F.greatest)(F.col(f"_base.{v}"), F.col(f"_{v}")).alias(v) for v, how in values.items()])


def matrix(spine: DataFrame, labels: DataFrame, cells: DataFrame, keys: list[str], hour: str, label: str, value: str) -> DataFrame:
    """(keys, hour, cells): for every hour of a key, the value of each of its labels in label order, null where there is none."""
    grid = spine.select(*keys, hour).join(labels.select(*keys, label).distinct(), keys).join(cells.select(*keys, hour, label, value), [*keys, hour, label], "left")
    return grid.groupBy(*keys, hour).agg(F.transform(F.array_sort(F.collect_list(F.struct(label, value))), lambda c: c[value]).alias("cells"))


def freshness(feeds: DataFrame, keys: list[str], source: str, at: str) -> DataFrame:
    """(keys, oldest, sources): the oldest fetch of a key's feeds, and a map from each source to its newest."""
    per = feeds.groupBy(*keys, source).agg(F.max(at).alias("_at"))
    return per.groupBy(*keys).agg(F.min("_at").alias("oldest"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(source, "_at")))).alias("sources"))
