from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import aero, geo, text, times, waves


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.mark.parametrize(
    ("raw", "norm"),
    [("Lake Angelus", "angelus"), ("Big School Lot Lake", "big school lot"), ("Lake", "lake"), ("Lk. St. Clair", "saint clair"), ("Crooked Lake (Big)", "crooked big"), ("Twp Line Lake", "township line"),
     ("O'Brien Lake", "o brien"), ("Café Lake", "cafe"), ("Lake Lake", "lake"), ("Upr Herring Lake", "upper herring"), ("Lake of the Clouds", "of the clouds"), (None, ""), ("...", "")],
)
def test_names(spark, raw, norm):
    assert one(spark, text.normalize_name(F.lit(raw).cast("string"))) == (norm,)


@pytest.mark.parametrize(
    ("wind", "fetch", "depth", "hs", "tp"),
    [(20, 5000, None, 0.4511, 2.474), (20, 40000, None, 1.276, 4.948), (15, 25000, 3.4, 0.5018, 2.83), (15, 25000, 1.0, 0.2482, 2.248), (30, 500000, None, 7.4286, 13.559), (0, 5000, None, 0.0, 0.0)],
)
def test_waves(spark, wind, fetch, depth, hs, tp):
    w, f, d = F.lit(float(wind)), F.lit(float(fetch)), F.lit(depth).cast("double")
    assert one(spark, F.round(waves.height_m(w, f, d), 4), F.round(waves.period_s(w, f, d), 3)) == (hs, tp)


def test_bins(spark):
    degrees = [0, 11, 11.25, 12, 180, 348.74, 348.75, 359.9]
    assert one(spark, *[geo.bin_half_up(F.lit(float(x))) for x in degrees]) == (0, 0, 1, 1, 8, 15, 0, 0)
    assert one(spark, geo.bin_half_even(F.lit(11.25)), geo.compass_point(F.lit(91.0)), geo.angle_diff(F.lit(350.0), F.lit(10.0))) == (0, "E", 20.0)


def test_tiles_end_at_the_border(spark):
    tiles = one(spark, geo.tiles(F.lit(42.5), F.lit(-84.0), F.lit(43.0), F.lit(-82.9)))[0]
    assert [(t.y, t.x) for t in tiles] == [(42, -84), (42, -83)]


def test_sun(spark):
    day, lat, lon = F.lit("2026-06-21").cast("date"), F.lit(42.6655), F.lit(-83.4187)
    got = one(spark, times.sun_event(day, lat, lon, True, times.CIVIL), times.sun_event(day, lat, lon, True), times.sun_event(day, lat, lon, False), times.sun_event(day, F.lit(80.0), lon, False))
    local = [F.date_format(F.from_utc_timestamp(F.lit(t), "America/Detroit"), "HH:mm") for t in got[:3]]
    minutes = [int(x[:2]) * 60 + int(x[3:]) for x in one(spark, *local)]
    assert all(abs(a - b) <= 2 for a, b in zip(minutes, (5 * 60 + 21, 5 * 60 + 56, 21 * 60 + 15), strict=True)) and got[3] is None


def test_spine_runs_on_utc(spark):
    start, end = F.lit(datetime(2026, 3, 8, 0)), F.lit(datetime(2026, 3, 8, 5))
    assert len(one(spark, times.hour_spine(start, end))[0]) == 5 and one(spark, times.hour_spine(end, start))[0] == []


def test_season_over_new_year(spark):
    inside = [times.in_season(F.lit(d).cast("date"), "11-15", "04-15") for d in ("2026-12-01", "2026-04-15", "2026-06-01")]
    assert one(spark, *inside) == (True, True, False)


def test_best_runway_end(spark):
    runways = F.array(F.struct(F.lit("09R/27L").alias("id"), F.lit(91).alias("heading"), F.lit(6521).alias("length_ft")), F.struct(F.lit("18").alias("id"), F.lit(180).alias("heading"), F.lit(None).cast("int").alias("length_ft")))
    ends = aero.runway_ends(runways)
    best = lambda wind, kt: aero.best_end(ends, F.lit(float(wind)), F.lit(float(kt)))["id"]
    assert one(spark, best(271, 10), best(180, 10), best(0, 10), best(0, 0)) == ("27L", "18", "18 rev", "09R")


def test_text_extraction(spark):
    t = F.lit("It is unlawful between the hours of 7:30 p.m. and 11:00 a.m. during July and August to exceed 10 miles per hour in section 16 and 40, town 4 north, range 7 east")
    h, s = text.hours(t), text.season(t)
    assert one(spark, h["start"], h["end"], s["start"], s["end"], text.speed_mph(t), text.survey_keys(t)) == ("19:30", "11:00", "07-01", "08-31", 10.0, ["04N07E16"])


@pytest.mark.parametrize(("raw", "miles"), [("1 1/2", 1.5), ("6+", 6.0), ("P6SM", 6.0), ("3/4SM", 0.75), ("x", None)])
def test_visibility(spark, raw, miles):
    assert one(spark, text.visibility_sm(F.lit(raw))) == (miles,)


def test_name_score(spark):
    pairs = [("a b", "a b"), ("big bass", "bass"), ("big bass", "little bass"), ("long bass", "bass"), ("", "x")]
    assert one(spark, *[F.round(text.name_score(F.lit(a), F.lit(b)), 3) for a, b in pairs]) == (1.0, 0.6, 0.15, 0.2, 0.0)
