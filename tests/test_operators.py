import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import conditions, linkage, places, rules, series, shapes
from tidemark.sources import feeds, html

T0 = datetime(2026, 1, 1)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_rules_first_match_and_absence(spark):
    schema = "n int, restriction_type string, scope string, hours string, season string, speed_mph double"
    df = spark.createDataFrame([(1, "slow_no_wake", "lakewide", "x", None, None), (2, "slow_no_wake", "lakewide", None, None, None), (3, "high_speed_hours", "zone", None, None, None), (4, "speed_limit", "lakewide", None, None, None), (5, "speed_limit", "lakewide", None, None, 40.0)], schema)
    got = rows(df.select("n", rules.default_ruleset().first_match()["verdict"]), "n")
    assert got == [(1, "conditional"), (2, "restricted"), (3, "unknown"), (4, "unknown"), (5, "clear")]


def test_rules_are_checked():
    with pytest.raises(ValueError, match="no such verdict"):
        rules.Ruleset([{"id": "a", "when": {}, "verdict": "fine"}])
    with pytest.raises(ValueError, match="no such parameter"):
        rules.Ruleset([{"id": "a", "when": {"x_lt": "$y"}, "verdict": "clear"}])


def test_worst_of_keeps_places_without_restrictions(spark):
    found = spark.createDataFrame([(1, "no_towing"), (1, "no_vessels"), (3, "other")], "id int, restriction_type string").select("*", F.lit("lakewide").alias("scope"), F.lit(None).cast("string").alias("hours"), F.lit(None).cast("string").alias("season"), F.lit(None).cast("double").alias("speed_mph"))
    out = rules.worst_of(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, name string"), found, rules.default_ruleset(), "id", F.col("name").isNotNull())
    assert rows(out.select("id", "verdict", "n_restrictions"), "id") == [(1, "restricted", 2), (2, "clear", 0), (3, "unknown", 1), (4, "unknown", 0)]


def hours(spark, levels):
    return spark.createDataFrame([("k", T0 + timedelta(hours=i), x) for i, x in enumerate(levels) if x is not None], "k string, h timestamp, level int")


def test_longest_run_is_the_earliest_of_equals(spark):
    got = rows(series.longest_run(hours(spark, [0, 0, 1, 0, 0, None, 0]), ["k"], "h", F.col("level") == 0, 2))
    assert got == [("k", T0, T0 + timedelta(hours=2), 2)]


def test_windows_fall_back_a_level(spark):
    assert [r[3:] for r in rows(series.windows(hours(spark, [0, 1, 2, 1, 1, 1]), ["k"], "h", "level", 2), "start")] == [(2, 1), (3, 1)]


def test_nearest_in_time_ties_and_limits(spark):
    left = spark.createDataFrame([(1, T0), (2, T0 + timedelta(hours=9))], "id int, ts timestamp").withColumn("k", F.lit(1))
    right = spark.createDataFrame([(7, T0 + timedelta(minutes=10)), (8, T0 - timedelta(minutes=10)), (9, T0 + timedelta(minutes=31))], "near int, at timestamp").withColumn("k", F.lit(1))
    assert rows(series.nearest_in_time(left, right, ["k"], "ts", "at", "near", 30).select("id", "near"), "id") == [(1, 8), (2, None)]


@pytest.mark.parametrize("bucket_hours", [3, 1e-7])
def test_in_periods_against_brute_force(spark, bucket_hours):
    at = lambda us: T0 + timedelta(microseconds=us)
    events = [(i, at(us)) for i, us in enumerate([0, 1, 999, 1000, 1001, 2500, 2500, -1, 999_999, 1_000_000])] + [(99, None)]
    periods = [(1, at(0), at(1000)), (2, at(1000), at(1001)), (3, at(5), at(5)), (4, at(-3), at(2501)), (5, None, at(9)), (6, at(999_999), at(1_000_001)), (7, at(9), at(3))]
    got = rows(series.in_periods(spark.createDataFrame(events, "id int, ts timestamp"), spark.createDataFrame(periods, "p int, s timestamp, e timestamp"), "ts", "s", "e", bucket_hours).select("id", "p"), "id", "p")
    assert got == sorted((i, p) for i, t in events for p, s, e in periods if t and s and s <= t < e)


def test_knn_widens_until_it_has_enough(spark):
    left = spark.createDataFrame([(1, 45.0, -85.0)], "id int, lat double, lon double")
    right = spark.createDataFrame([(1, 45.0, -85.1), (2, 45.0, -75.0), (3, 30.0, -85.0)], "id int, lat double, lon double")
    assert [r[1:3] for r in rows(places.nearest(left, right, 2, 10.0), "rank")] == [(1, 1), (2, 2)]
    assert rows(places.nearest(left, right.where("id < 0"), 2, 10.0)) == []


def test_conditions_skip_what_is_unknown(spark):
    h = spark.createDataFrame([(1, 10.0, 25.0, None), (2, 5.0, None, 2.0), (3, 13.0, 14.0, 9.0)], "id int, wind_kt double, gust_kt double, vis_sm double")
    got = rows(conditions.scored(h).select("id", "level", "limiting", F.array_contains("skipped", "visibility")), "id")
    assert got == [(1, "unfavorable", "gusts", True), (2, "unfavorable", "visibility", False), (3, "marginal", "wind", False)]


def test_changes_are_null_safe(spark):
    old, new = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id int, v string"), spark.createDataFrame([(1, None), (2, None), (4, "b")], "id int, v string")
    assert rows(linkage.changes(old, new, "id"), "id") == [(2, "changed"), (3, "removed"), (4, "new")]


def test_spelling_counts(spark):
    r = spark.createDataFrame([(1, "kimball", "x")], "rid int, norm string, b string")
    p = spark.createDataFrame([(5, "kimbal", "x"), (6, "other", "x")], "pid int, norm string, b string")
    (best,) = linkage.best(linkage.scored(r, p, "b", spelling=True)).collect()
    assert best.pid == 5 and best.state == "review"


def polygon(spark, points):
    return spark.createDataFrame([(1, [{"x": float(x), "y": float(y)} for x, y in points])], "pid int, ring array<struct<x:double,y:double>>")


def test_shapes(spark):
    p = polygon(spark, [(0, 0), (10, 0), (10, 4), (0, 4)])
    area, extent = p.select(shapes.area(F.col("ring")), shapes.extents(0.5)("ring")).first()
    assert area == 40 and extent[0] == pytest.approx(4) and extent[4] == pytest.approx(10)
    assert shapes.sampled(p, 2.0).where("x > 0 and y > 0").count() >= 4
    fetch = p.select(shapes.fetches(100.0)("ring", F.lit(1.0), F.lit(1.0))).first()[0]
    assert [round(fetch[i], 6) for i in (0, 4, 8, 12)] == [3, 9, 1, 1]


def test_html_entries(spark):
    page = "<script>'<p>no</p>'</script><p>before</p><p><b>Head</b></p><p>one &amp; two</p><li>three</li><h2>Next</h2>"
    found = html.entries(html.blocks(spark.createDataFrame([(1, page), (2, None)], "id int, html string"), "id", "html"), "id")
    assert rows(found, "entry") == [(1, 1, "Head", ["one & two", "three"]), (1, 2, "Next", [])]


def test_buoys(spark, tmp_path):
    (tmp_path / "obs.txt").write_text("#STN LAT\n45007 42.7 -87.0 2026 07 01 12 50 200 5.0 MM 0.3 MM MM MM MM MM MM MM MM MM MM\nbad\n")
    (r,) = feeds.buoys(spark, str(tmp_path / "obs.txt")).collect()
    assert (r.station, r.at, r.gust_kt, r.wave_m) == ("45007", datetime(2026, 7, 1, 12, 50), None, 0.3) and r.wind_kt == pytest.approx(9.719, abs=1e-3)


def test_nearest_across_the_date_line_and_the_poles(spark):
    """Against all distances: near pairs on both sides of 180 degrees and around a pole, and rows whose nearest is far away."""
    r = random.Random(3)
    spots = [(89.9, 0.0), (89.8, 180.0), (-89.95, 77.0), (10.0, 179.99), (10.0, -179.99), (0.0, 0.0), (71.0, 20.0), (71.2, 21.0)] + [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(40)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "id long, lat double, lon double")
    nm = lambda a, b: 2 * 3440.065 * math.asin(min(1, math.sqrt(math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)))
    for reach in (30.0, 900.0, 4000.0):
        want = {(i, j) for i, a in enumerate(spots) for j, b in enumerate(spots) if nm(a, b) <= reach}
        got = [(x.id, x.other) for x in places.near_pairs(df, df, reach).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    got = {(x.id, x.rank): x.other for x in places.nearest(df, df, 3, 30.0).collect()}
    for i, a in enumerate(spots):
        near = sorted((round(nm(a, b), 6), j) for j, b in enumerate(spots))[:3]
        assert [got[i, k] for k in (1, 2, 3)] == [j for _, j in near]


def test_longest_run_against_single_lines():
    r = np.random.default_rng(5)
    for n in (3, 4, 9, 40):
        xy = r.uniform(-20, 20, (n, 2)) if n < 9 else np.stack([(10 + r.uniform(-4, 4, n)) * f(np.linspace(0, 2 * np.pi, n, endpoint=False)) for f in (np.cos, np.sin)], 1)
        for bearing in (0, 37, 90, 161):
            p = shapes._turned(xy, bearing)
            q, best = np.roll(p, -1, 0), 0.0
            for y in np.arange(p[:, 1].min() + 0.25, p[:, 1].max(), 0.5):
                cut = (p[:, 1] > y) != (q[:, 1] > y)
                x = np.sort(p[cut, 0] + (y - p[cut, 1]) / (q[cut, 1] - p[cut, 1]) * (q[cut, 0] - p[cut, 0]))
                best = max(best, float((x[1::2] - x[::2]).max(initial=0.0)))
            assert abs(shapes.longest_run(xy, bearing, 0.5) - best) < 1e-9
