"""Distances, bearings, cells and tiles as Column expressions; angles in degrees, distances in nautical miles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in nautical miles; names of the sixteen compass points.
EARTH_NM = 3440.065
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def distance_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance (haversine)."""
    dp, dl = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dp), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl), 2)
    return F.lit(2 * EARTH_NM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial true bearing from the first point to the second, 0 to 360 (360 excluded)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return norm360(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))))


def norm360(deg: Column) -> Column:
    return F.pmod(deg, F.lit(360.0))


def angle_diff(a: Column, b: Column) -> Column:
    """Smallest difference of two bearings, 0 to 180."""
    d = F.abs(norm360(a) - norm360(b))
    return F.least(d, 360.0 - d)


def advance(lat: Column, lon: Column, course: Column, nm: Column) -> Column:
    """struct(lat, lon): dead reckoning over a short distance on a flat earth."""
    north, east = nm / 60 * F.cos(F.radians(course)), nm / 60 * F.sin(F.radians(course))
    return F.struct((lat + north).alias("lat"), (lon + east / F.cos(F.radians(lat))).alias("lon"))


def cell(value: Column, degrees: float) -> Column:
    """Number of the grid cell: `value / degrees`, halves to even."""
    return F.bround(value / F.lit(float(degrees))).cast("long")


def bin_half_up(bearing: Column, bins: int = 16) -> Column:
    """Bearing bin, exact halves upward."""
    return (F.floor(norm360(bearing) / (360.0 / bins) + 0.5) % bins).cast("int")


def bin_half_even(bearing: Column, bins: int = 16) -> Column:
    """Bearing bin, exact halves to the even bin."""
    return (F.bround(norm360(bearing) / (360.0 / bins)).cast("long") % bins).cast("int")


def compass_point(bearing: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in COMPASS]), bin_half_even(bearing) + 1)


def box_distance_nm(lat: Column, lon: Column, south: Column, west: Column, north: Column, east: Column) -> Column:
    """Distance from a point to the nearest place of a box: a lower bound for everything inside the box."""
    return distance_nm(lat, lon, F.least(F.greatest(lat, south), north), F.least(F.greatest(lon, west), east))


def box_around(lat: Column, lon: Column, margin_nm: float) -> Column:
    """struct(south, west, north, east) that holds every point within `margin_nm`."""
    dlat = F.lit(margin_nm / 60)
    dlon = dlat / F.greatest(F.cos(F.radians(lat)), F.lit(0.01))
    return F.struct((lat - dlat).alias("south"), (lon - dlon).alias("west"), (lat + dlat).alias("north"), (lon + dlon).alias("east"))


def tiles(south: Column, west: Column, north: Column, east: Column) -> Column:
    """array<struct<y, x>>: the one-degree tiles of a box. A box that ends on a tile's border does not enter the next tile."""

    def span(low: Column, high: Column) -> Column:
        first, last = F.floor(low).cast("long"), (F.ceil(high) - 1).cast("long")
        return F.sequence(first, F.greatest(first, last))

    rows = F.transform(span(south, north), lambda y: F.transform(span(west, east), lambda x: F.struct(y.alias("y"), x.alias("x"))))
    return F.flatten(rows)


def forward_cone(bearing: Column, course: Column, nm: Column, half_deg: float = 45.0, near_nm: float = 2.0) -> Column:
    """Whether a place lies ahead, or so near that direction does not matter."""
    return (nm <= near_nm) | (angle_diff(bearing, course) <= half_deg)
