"""Wind waves by the 1984 Shore Protection Manual formulas, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the manual's formulas and of unit conversion.
G = 9.80665
KT_TO_MS = 0.5144444
FULL_HEIGHT, FULL_PERIOD = 0.2433, 8.134
METRES_PER_INCH = 0.0254


def wind_stress(wind_kt: Column) -> Column:
    return F.lit(0.71) * F.pow(F.greatest(wind_kt, F.lit(0.0)) * F.lit(KT_TO_MS), F.lit(1.23))


def _calm(wind_kt: Column, fetch_m: Column, value: Column) -> Column:
    return F.when((wind_kt <= 0) | (fetch_m <= 0), F.lit(0.0)).otherwise(value)


def height_m(wind_kt: Column, fetch_m: Column, depth_m: Column | None = None) -> Column:
    """Significant height. Without a depth (or where it is null) the deep-water form; both are capped at full development."""
    ua = wind_stress(wind_kt)
    f = F.lit(G) * fetch_m / F.pow(ua, 2)
    h = F.lit(1.6e-3) * F.sqrt(f)
    if depth_m is not None:
        a = F.tanh(F.lit(0.530) * F.pow(F.lit(G) * F.greatest(depth_m, F.lit(0.1)) / F.pow(ua, 2), F.lit(0.75)))
        h = F.when(depth_m.isNull(), h).otherwise(F.lit(0.283) * a * F.tanh(F.lit(0.00565) * F.sqrt(f) / a))
    return _calm(wind_kt, fetch_m, F.least(h, F.lit(FULL_HEIGHT)) * F.pow(ua, 2) / F.lit(G))


def period_s(wind_kt: Column, fetch_m: Column, depth_m: Column | None = None) -> Column:
    """Peak period, under the same rules as `height_m`."""
    ua = wind_stress(wind_kt)
    root = F.cbrt(F.lit(G) * fetch_m / F.pow(ua, 2))
    t = F.lit(0.2857) * root
    if depth_m is not None:
        b = F.tanh(F.lit(0.833) * F.pow(F.lit(G) * F.greatest(depth_m, F.lit(0.1)) / F.pow(ua, 2), F.lit(0.375)))
        t = F.when(depth_m.isNull(), t).otherwise(F.lit(7.54) * b * F.tanh(F.lit(0.0379) * root / b))
    return _calm(wind_kt, fetch_m, F.least(t, F.lit(FULL_PERIOD)) * ua / F.lit(G))


def inches(metres: Column) -> Column:
    """Whole inches, halves up."""
    return F.floor(metres / F.lit(METRES_PER_INCH) + 0.5).cast("long")


def steep_chop(height_in: Column, period: Column) -> Column:
    return (period < 2.0) & (height_in > 6.0)


def band(height_in: Column, usable: Column, ok: float = 8.0, most: float = 12.0) -> Column:
    """Band of a point on a map: by height where there is room to land, else `norun`."""
    return F.when(~F.coalesce(usable, F.lit(False)), "norun").when(height_in <= ok, "calm").when(height_in <= most, "chop").otherwise("rough")
