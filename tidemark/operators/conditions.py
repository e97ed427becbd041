"""Hourly conditions: a level for each factor, the worst of them, and the first factor that reached it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("favorable", "marginal", "unfavorable")
# Thunderstorm codes of the weather table, and words of alerts that weigh like a warning.
THUNDER_CODES = (95, 96, 99)
GRAVE = ("lake wind", "small craft", "thunderstorm", "tornado", "winter", "blizzard", "ice storm", "freezing rain", "snow squall", "hurricane", "tropical storm", "warning")
CONVECTIVE = ("thunderstorm", "tornado", "severe")


@dataclass(frozen=True)
class Limits:
    """Thresholds: up to (or from) the first a factor is favorable, up to (or from) the second marginal."""

    wind: tuple[float, float] = (12, 18)
    gust_spread: tuple[float, float] = (8, 12)
    crosswind: tuple[float, float] = (8, 12)
    ceiling: tuple[float, float] = (3000, 1500)
    visibility: tuple[float, float] = (6, 3)
    density_altitude: tuple[float, float] = (3500, 5000)
    temperature: tuple[float, float] = (40, 32)
    waves: tuple[float, float] = (8, 12)
    fog_spread_f: float = 3
    daylight: tuple[float, float] = (0.9, 1 / 3)


def low(value: Column, limits: tuple[float, float]) -> Column:
    """Rank of a factor that is better when lower; null for null."""
    return F.when(value.isNull(), None).when(value <= limits[0], 0).when(value <= limits[1], 1).otherwise(2)


def high(value: Column, limits: tuple[float, float]) -> Column:
    return F.when(value.isNull(), None).when(value >= limits[0], 0).when(value >= limits[1], 1).otherwise(2)


def _alerts_have(words: tuple[str, ...]) -> Column:
    return F.exists(F.coalesce("alerts", F.array().cast("array<string>")), lambda e: F.lower(e).rlike("|".join(words)))


#: The columns that are read, with their kinds; those a frame lacks count as unknown.
COLUMNS = {
    "wind_kt": "double", "gust_kt": "double", "xwind_kt": "double", "xwind_gust_kt": "double", "ceiling_ft": "double", "ceiling_known": "boolean", "vis_sm": "double",
    "precip_mm": "double", "precip_prob": "double", "weather_code": "int", "cape": "double", "da_ft": "double", "temp_f": "double", "dewpoint_f": "double", "taf_fog": "boolean",
    "alerts": "array<string>", "daylight": "double",
}


def factors(limits: Limits = Limits()) -> dict[str, Column]:
    """Factor -> rank (0 to 2, null if its input is unknown), in the order in which they limit."""
    c, n = F.col, lambda name: F.coalesce(F.col(name), F.lit(0.0))
    # A gust of 0 is an absent one.
    spread = F.greatest(F.lit(0.0), F.coalesce(F.nullif(c("gust_kt"), F.lit(0.0)), c("wind_kt")) - c("wind_kt"))
    across = F.greatest(low(c("xwind_kt"), limits.crosswind), F.when(F.coalesce("xwind_gust_kt", "xwind_kt") <= limits.crosswind[1], 0).otherwise(2))
    rain = F.when((n("precip_mm") <= 0) & (n("precip_prob") < 30), 0).when((n("precip_mm") <= 2.5) & (n("precip_prob") < 60), 1).otherwise(2)
    n_alerts = F.size(F.coalesce("alerts", F.array().cast("array<string>")))
    storm = F.coalesce(c("weather_code").isin(*THUNDER_CODES), F.lit(False)) | _alerts_have(CONVECTIVE)
    convection = F.when(storm, 2).when(n("cape") < 500, 0).when(n("cape") < 1000, 1).otherwise(2)
    moist = (c("temp_f") - c("dewpoint_f") <= limits.fog_spread_f) & (c("wind_kt") <= 5)
    fog = F.when(F.coalesce("taf_fog", F.lit(False)) | F.coalesce(c("vis_sm") < limits.visibility[1], F.lit(False)), 2).when(F.coalesce(moist, F.lit(False)), 1).otherwise(0)
    return {
        "wind": low(n("wind_kt"), limits.wind),
        "gusts": low(F.coalesce(spread, F.lit(0.0)), limits.gust_spread),
        "xwind_runway": F.when(c("xwind_kt").isNotNull(), across),
        "ceiling": F.when(F.coalesce("ceiling_known", F.lit(False)), F.coalesce(high(c("ceiling_ft"), limits.ceiling), F.lit(0))),
        "visibility": high(c("vis_sm"), limits.visibility),
        "precip": F.when(c("precip_mm").isNotNull() | c("precip_prob").isNotNull(), rain),
        "convection": F.when(c("cape").isNotNull() | c("weather_code").isNotNull() | (n_alerts > 0), convection),
        "density_altitude": low(c("da_ft"), limits.density_altitude),
        "fog": F.when(c("temp_f").isNotNull() & c("dewpoint_f").isNotNull(), fog),
        "temperature": high(c("temp_f"), limits.temperature),
        "alert": F.when(n_alerts == 0, 0).when(_alerts_have(GRAVE), 2).otherwise(1),
        "daylight": high(F.coalesce("daylight", F.lit(1.0)), limits.daylight),
    }


def worst_and_first(ranks: dict[str, Column]) -> tuple[Column, Column]:
    """(the worst rank, the first factor that has it; null if the worst is favorable). Unknown factors are left out."""
    worst = F.greatest(*[F.coalesce(r, F.lit(0)) for r in ranks.values()])
    return worst, F.when(worst > 0, F.coalesce(*[F.when(r == worst, F.lit(name)) for name, r in ranks.items()]))


def scored(hours: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """`hours` with `rank`, `level`, `limiting` and `skipped` (factors without input)."""
    full = hours.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in COLUMNS.items() if c not in hours.columns])
    ranks = factors(limits)
    full = full.select("*", *[r.cast("int").alias(f"_{name}") for name, r in ranks.items()])
    known = {name: F.col(f"_{name}") for name in ranks}
    worst, first = worst_and_first(known)
    out = full.withColumn("rank", worst).withColumn("limiting", first).withColumn("skipped", F.array_compact(F.array(*[F.when(r.isNull(), F.lit(n)) for n, r in known.items()])))
    return out.withColumn("level", level(F.col("rank"))).select(*hours.columns, "rank", "level", "limiting", "skipped")


def level(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), rank + 1)


def worse_of(air: Column, water: Column) -> Column:
    """The worse of two struct(rank, limiting); water counts only where it is known, and nothing counts without air."""
    return F.when(air["rank"].isNull(), None).when(water["rank"] > air["rank"], water).otherwise(air)


def first_complete(*sources: tuple[Column, ...]) -> Column:
    """The first tuple whose members are all there, as struct(c0, c1, ...): values of different sources are never mixed."""

    def whole(t: tuple[Column, ...]) -> Column:
        ok = F.lit(True)
        for x in t:
            ok = ok & x.isNotNull()
        return F.when(ok, F.struct(*[x.alias(f"c{i}") for i, x in enumerate(t)]))

    return F.coalesce(*[whole(t) for t in sources])
