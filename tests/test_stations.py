"""Throttled rows against a plain loop, and the schedule where the clocks change."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import schedule
from tidemark.operators import stations

START = datetime(2024, 1, 1)


def nm(a, b):
    p, q = [math.radians(x) for x in a], [math.radians(x) for x in b]
    h = math.sin((q[0] - p[0]) / 2) ** 2 + math.cos(p[0]) * math.cos(q[0]) * math.sin((q[1] - p[1]) / 2) ** 2
    return 2 * 3440.065 * math.asin(min(1.0, math.sqrt(h)))


def rows():
    return [(i % 3, i, START + timedelta(seconds=(i * 37) % 1000), i % 4 > 0, 44 + (i * 7 % 13) / 500, -86.0) for i in range(400)]


@pytest.mark.parametrize(("least", "ok"), [(None, None), (None, "ok"), (0.2, None)])
def test_throttled_is_a_loop_over_each_key(spark, least, ok):
    df = spark.createDataFrame(rows(), "k int, id int, at timestamp, ok boolean, lat double, lon double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a key spans batches
    try:
        got = {r.id: r.taken for r in stations.throttled(df, ["k"], "at", 30, least, ok).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = {}, {}
    for k, i, at, fine, lat, lon in sorted(rows(), key=lambda r: (r[0], r[2], r[1])):
        before = last.get(k)
        want[i] = before is None or ((at - before[0]).total_seconds() >= 30 and (least is None or nm(before[1], (lat, lon)) >= least))
        if want[i] and (fine or not ok):
            last[k] = (at, (lat, lon))
    assert got == want and 0 < sum(got.values()) < len(got)


def test_throttled_takes_no_rows(spark):
    assert stations.throttled(spark.createDataFrame([], "k int, at timestamp"), ["k"], "at", 5).count() == 0


@pytest.mark.parametrize(
    ("now", "want"),
    [
        ("2024-03-10 07:40:00", ["2024-03-10 07:30:00"]),  # 02:30 does not exist: it is 03:30 by the new clock
        ("2024-11-03 06:00:00", ["2024-11-03 05:30:00"]),  # 01:30 comes twice: the first counts
        ("2024-11-03 07:10:00", []),
        ("2024-01-10 04:00:00", []),
    ],
)
def test_due_where_the_clocks_change(spark, now, want):
    times = ["02:30"] if "-03-" in now else ["01:30"]
    df = spark.range(1).select(schedule.due(F.lit(now).cast("timestamp"), F.lit(None).cast("timestamp"), times, "America/Detroit").cast("array<string>").alias("due"))
    assert df.first().due == want


def test_schedule_edges(spark):
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    r = spark.range(1).select(
        schedule.all_times(["22:00", "06:00"], ["06:00", "12:30"]).alias("all"), schedule.following(now, []).alias("none"), schedule.stale(now, F.lit("not a time")).alias("bad"),
        schedule.stale(now, F.lit("2024-01-10 09:00:00")).alias("just"), schedule.morning(F.to_date(now), F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"), "sunrise", "10:00").alias("m"),
    ).first()
    assert r["all"] == ["06:00", "12:30", "22:00"] and r.none is None and r.bad and not r.just
    assert r.m.start.hour == 0 and r.m.end.hour == 10
