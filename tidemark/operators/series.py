"""Hourly series: runs of qualifying hours, windows of a day, lookups in time, histories. Keys partition every window; nothing runs over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(hours: DataFrame, keys: list[str], hour: str, ok: Column) -> DataFrame:
    """Runs of consecutive hours in which `ok` holds: keys, start, end (exclusive), n. Rows of one key and hour count once."""
    good = hours.where(ok).select(*keys, hour).distinct()
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(hour))
    island = (F.unix_seconds(F.col(hour)) - number * 3600).alias("_island")
    out = good.select(*keys, F.col(hour), island).groupBy(*keys, "_island").agg(F.min(hour).alias("start"), F.max(hour).alias("_last"), F.count("*").alias("n"))
    return out.select(*keys, "start", (F.col("_last") + F.expr("interval 1 hour")).alias("end"), "n")


def longest_run(hours: DataFrame, keys: list[str], hour: str, ok: Column, least: int = 1) -> DataFrame:
    """The longest run of each key, the earliest of equals, if it has at least `least` hours."""
    found = runs(hours, keys, hour, ok).where(F.col("n") >= least)
    return found.groupBy(*keys).agg(F.max_by(F.struct("start", "end", "n"), F.struct("n", -F.unix_seconds("start"))).alias("r")).select(*keys, "r.*")


def windows(hours: DataFrame, keys: list[str], hour: str, level: str, least: int = 2, levels: int = 2) -> DataFrame:
    """All runs of at least `least` hours at the best level a key has any: level 0 if it has such, else 1 or better, and so on.

    `level` is a column of ranks, 0 the best; the result's `score` is the level that was reached.
    """
    tiers = [runs(hours, keys, hour, F.col(level) <= tier).where(F.col("n") >= least).withColumn("score", F.lit(tier)) for tier in range(levels)]
    every = tiers[0]
    for t in tiers[1:]:
        every = every.unionByName(t)
    best = F.min("score").over(Window.partitionBy(*keys))
    return every.withColumn("_best", best).where(F.col("score") == F.col("_best")).drop("_best")


def ended_by(found: DataFrame, hours: DataFrame, keys: list[str], hour: str, reason: str) -> DataFrame:
    """Runs with `ended_by`: the reason given for the hour at which the run ends; null if there is no such hour."""
    after = hours.select(*keys, F.col(hour).alias("end"), F.col(reason).alias("ended_by"))
    return found.join(after, [*keys, "end"], "left")


def newest(rows: DataFrame, keys: list[str], at: str, order: str) -> DataFrame:
    """Each key's newest row; of rows of one time the first by `order`. A partial aggregate, so no key's rows are sorted."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(at), -F.col(order).cast("long")))
    return rows.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def append_or_replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All of `new`, and of `old` what has no such key in `new`."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def trend(history: DataFrame, keys: list[str], at: str, rank: str, gust: str) -> DataFrame:
    """`history` with `trend` against the row before: by rank, then by a change of gusts of 3 or more; null for a key's first row."""
    w = Window.partitionBy(*keys).orderBy(at)
    before, gusts = F.lag(rank).over(w), F.lag(gust).over(w)
    moved = F.col(gust) - gusts
    word = F.when(F.col(rank) < before, "improving").when(F.col(rank) > before, "worsening").when(moved >= 3, "worsening").when(moved <= -3, "improving").otherwise("steady")
    return history.withColumn("trend", F.when(before.isNotNull(), word))


def blocks(rows: DataFrame, keys: list[str], ts: str, hours: int, *aggregates: Column) -> DataFrame:
    """Aggregates over tumbling blocks of so many hours: keys, block, then the aggregates."""
    return rows.groupBy(*keys, F.window(ts, f"{hours} hours").alias("_w")).agg(*aggregates).withColumn("block", F.col("_w.start")).drop("_w")


def sessions(rows: DataFrame, keys: list[str], ts: str, gap_minutes: int) -> DataFrame:
    """Rows of a key that follow within the gap are one session: keys, start, last, n."""
    # session_window merges in the shuffle and so needs no lag over sorted rows.
    w = F.session_window(ts, f"{gap_minutes} minutes")
    return rows.groupBy(*keys, w.alias("_w")).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("_w")


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, right_id: str, minutes: int) -> DataFrame:
    """Rows of `left` with the `right` row of their keys that is nearest in time, within `minutes`; of two as near the earlier, then the smaller id.

    Adds `right_ts` and `right_id`, null where none is near. `right` rows are posted under the time buckets they can reach, so the join is an
    equality and never compares all pairs of a key.
    """
    width = minutes * 60
    bucket = lambda c: F.floor(F.unix_seconds(c) / width)
    near = right.select(*keys, F.col(right_ts).alias("_t"), F.col(right_id).alias("_id"))
    near = near.withColumn("_b", F.explode(F.array(bucket("_t") - 1, bucket("_t"), bucket("_t") + 1)))
    asks = left.withColumn("_b", bucket(F.col(left_ts))).withColumn("_row", F.monotonically_increasing_id())
    gap = F.abs(F.unix_micros("_t") - F.unix_micros(F.col(left_ts)))
    met = asks.join(near, [*keys, "_b"], "left").withColumn("_gap", F.when(gap <= width * 1_000_000, gap))
    first = {c: F.first(c).alias(c) for c in left.columns}
    best = F.min_by(F.struct("_t", "_id"), F.when(F.col("_gap").isNotNull(), F.struct("_gap", "_t", "_id"))).alias("_n")
    out = met.groupBy("_row").agg(*first.values(), best)
    return out.select(*left.columns, F.col("_n._t").alias(right_ts), F.col("_n._id").alias(right_id))


def in_periods(rows: DataFrame, periods: DataFrame, ts: str, start: str, end: str, bucket_hours: float) -> DataFrame:
    """Rows joined with the periods [start, end) that hold them; periods are posted under the time buckets they touch, which may be shorter than a second."""
    width = max(1, round(bucket_hours * 3_600_000_000))
    bucket = lambda c: F.floor(F.unix_micros(c) / width)
    posted = periods.withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    return rows.withColumn("_b", bucket(F.col(ts))).join(posted, "_b").where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("_b")
