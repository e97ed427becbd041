"""Text for people, and values out of text that people wrote: winds, ages, distances, levels, lengths, times. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Knots a mile an hour, compass words in order, cloud covers that make a ceiling, and tokens of fog.
MPH_TO_KT = 0.868976
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
CEILING_COVERS = ["BKN", "OVC", "OVX"]
FOG_TOKENS = ["FG", "FZFG", "MIFG", "BCFG", "PRFG"]


def whole(x: Column) -> Column:
    """Rounded half up, as a long."""
    return F.floor(x + 0.5).cast("long")


def range_top_kt(words: Column) -> Column:
    """`5 to 10 mph`: the greatest number, in knots; null without one."""
    return F.array_max(F.transform(F.regexp_extract_all(words, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("double"))) * F.lit(MPH_TO_KT)


def compass_deg(word: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(c) for c in COMPASS]), F.upper(F.trim(word)))
    return F.when(at > 0, (at - 1) * 22.5)


def length_ft(dimension: Column) -> Column:
    """`6521x150`: 6521; null for anything that is no number before an x."""
    return F.when(F.instr(dimension, "x") > 0, F.trim(F.substring_index(dimension, "x", 1)).try_cast("double").cast("long"))


def heading(deg: Column) -> Column:
    """Three digits, 360 for north."""
    n = F.pmod(whole(deg), F.lit(360))
    return F.lpad(F.when(n == 0, 360).otherwise(n).cast("string"), 3, "0")


def _gust(kt: Column, gust: Column, sign: str) -> Column:
    return F.when(whole(gust) > whole(kt), F.concat(F.lit(sign), whole(gust).cast("string"))).otherwise("")


def wind(deg: Column, kt: Column, gust: Column) -> Column:
    """`240/12 G18`, `VRB/4`, `calm`; null without a speed."""
    said = F.concat(F.coalesce(heading(deg), F.lit("VRB")), F.lit("/"), whole(kt).cast("string"), _gust(kt, gust, " G"))
    return F.when(whole(kt) == 0, "calm").otherwise(said)


def speed(kt: Column, gust: Column) -> Column:
    """`12G18`, `12`, or nothing."""
    return F.coalesce(F.concat(whole(kt).cast("string"), _gust(kt, gust, "G")), F.lit(""))


def distance(nm: Column) -> Column:
    """One decimal below 10, of the exact value; a tie (.25, .75) goes up."""
    exact = F.when(F.pmod(nm * 2, F.lit(1)) == 0.5, nm + 1e-9).otherwise(nm)
    return F.concat(F.when(nm < 10, F.format_number(exact.cast("double"), 1)).otherwise(whole(nm).cast("string")), F.lit(" nm"))


def age(minutes: Column) -> Column:
    """`14 min`, `2 h`, `2 h 5 min`."""
    m = F.greatest(F.lit(0), whole(minutes))
    h, r = F.floor(m / 60).cast("string"), m % 60
    return F.when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).when(r == 0, F.concat(h, F.lit(" h"))).otherwise(F.concat(h, F.lit(" h "), r.cast("string"), F.lit(" min")))


def ago(minutes: Column) -> Column:
    return F.when(minutes < 1, "just now").otherwise(F.concat(age(minutes), F.lit(" ago")))


def restriction(kind_label: Column, mph: Column, zone: Column, scope: Column, hours: Column, season: Column, partly: Column) -> Column:
    """One line about a restriction; parts that are null are left out."""
    first = F.when(mph.isNotNull(), F.concat(mph.cast("string"), F.lit(" mph limit"))).otherwise(kind_label)
    where = F.when(zone, F.coalesce(scope, F.lit("in a marked zone"))).otherwise("lakewide")
    return F.concat_ws(" · ", first, where, hours, season, F.when(partly, "covers part of this water"))


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def hhmm(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def epoch(seconds: Column) -> Column:
    """A timestamp of a number or text of seconds; null if it is neither."""
    return F.timestamp_seconds(seconds.try_cast("double"))


def day_word(day: Column, today: Column) -> Column:
    """today, tomorrow, yesterday, or the weekday."""
    n = F.datediff(day, today)
    return F.when(n == 0, "today").when(n == 1, "tomorrow").when(n == -1, "yesterday").otherwise(F.date_format(day, "EEEE"))


def shown_visibility(sm: Column) -> Column:
    """Halves to even, at most 10."""
    return F.least(F.bround(sm), F.lit(10.0))


def shown_hundreds(ft: Column) -> Column:
    return F.bround(ft / 100) * 100


def ceiling_ft(clouds: Column, vertical: Column) -> Column:
    """The lowest base of a covering layer (array of struct cover, base) or the vertical visibility; null if there is neither."""
    bases = F.transform(F.filter(clouds, lambda c: c["cover"].isin(CEILING_COVERS) & c["base"].isNotNull()), lambda c: c["base"].cast("double"))
    return F.array_min(F.concat(F.coalesce(bases, F.array().cast("array<double>")), F.filter(F.array(vertical.cast("double")), lambda v: v.isNotNull())))


def has_fog(weather: Column) -> Column:
    return F.upper(F.coalesce(weather, F.lit(""))).rlike("|".join(FOG_TOKENS))


def station_wind(deg: Column, kt: Column, gust: Column) -> Column:
    """struct(dir_deg, speed_kt, gust_kt) of a station's report: no direction in calm or variable wind; null for a dead sensor."""
    speed_kt = F.bround(kt).cast("int")
    direction = F.when(speed_kt == 0, None).otherwise(F.pmod(F.bround(deg).cast("int"), F.lit(360)))
    return F.when(speed_kt.isNotNull() | direction.isNotNull(), F.struct(direction.alias("dir_deg"), speed_kt.alias("speed_kt"), F.bround(gust).cast("int").alias("gust_kt")))
