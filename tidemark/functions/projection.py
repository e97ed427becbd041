"""The oblique Mercator projection: metres to the east and north of points on the ellipsoid, back again, and the angle between grid and true north. All are Columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Oblique:
    """An oblique Mercator grid: ellipsoid, centre, azimuth of the central line and of the grid, scale, and the coordinates of the natural origin."""

    a: float
    inverse_flattening: float
    lat: float
    lon: float
    azimuth: float
    grid: float
    scale: float
    east: float
    north: float

    @property
    def e2(self) -> float:
        f = 1 / self.inverse_flattening
        return f * (2 - f)

    def constants(self) -> dict[str, float]:
        """What the formulas need of the grid itself."""
        lat, e2 = math.radians(self.lat), self.e2
        e, sin = math.sqrt(e2), math.sin(lat)
        b = math.sqrt(1 + e2 * math.cos(lat) ** 4 / (1 - e2))
        d = max(b * math.sqrt(1 - e2) / (math.cos(lat) * math.sqrt(1 - e2 * sin * sin)), 1.0)
        t = math.tan(math.pi / 4 - lat / 2) / ((1 - e * sin) / (1 + e * sin)) ** (e / 2)
        f = d + math.copysign(math.sqrt(d * d - 1), lat)
        gamma = math.asin(math.sin(math.radians(self.azimuth)) / d)
        lon = math.radians(self.lon) - math.asin((f - 1 / f) / 2 * math.tan(gamma)) / b
        return {"a": self.a * b * self.scale * math.sqrt(1 - e2) / (1 - e2 * sin * sin), "b": b, "h": f * t**b, "lon": lon, "sin_g": math.sin(gamma), "cos_g": math.cos(gamma), "e": e}


#: The grid in which the library's waters are measured, and its ellipsoid.
MEASURED = Oblique(6378137.0, 298.257222101, 45.30916666666666, -86.0, 337.25556, 337.25556, 0.9996, 2546731.496, -4354009.816)
#: The series for the latitude of a conformal one, by powers of the squared eccentricity from the first on.
SERIES = {2: [1 / 2, 5 / 24, 1 / 12, 13 / 360], 4: [0.0, 7 / 48, 29 / 240, 811 / 11520], 6: [0.0, 0.0, 7 / 120, 81 / 1120], 8: [0.0, 0.0, 0.0, 4279 / 161280]}
#: Degrees of latitude over which the direction of north is taken.
STEP = 1e-4


def to_grid(lat: Column, lon: Column, grid: Oblique = MEASURED) -> Column:
    """struct(x, y): metres to the east and north of a place in degrees."""
    c, turn = grid.constants(), math.radians(grid.grid)
    phi, sin = F.radians(lat), F.sin(F.radians(lat))
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - c["e"] * sin) / (1 + c["e"] * sin), F.lit(c["e"] / 2))
    q = c["h"] / F.pow(t, F.lit(c["b"]))
    away = c["b"] * (F.radians(lon) - c["lon"])
    s, big = (q - 1 / q) / 2, (q + 1 / q) / 2
    u_part = (s * c["sin_g"] - F.sin(away) * c["cos_g"]) / big
    v = F.log((1 - u_part) / (1 + u_part)) * (c["a"] / (2 * c["b"]))
    u = F.atan2(s * c["cos_g"] + F.sin(away) * c["sin_g"], F.cos(away)) * (c["a"] / c["b"])
    x, y = v * math.cos(turn) + u * math.sin(turn) + grid.east, u * math.cos(turn) - v * math.sin(turn) + grid.north
    return F.struct(x.alias("x"), y.alias("y"))


def from_grid(x: Column, y: Column, grid: Oblique = MEASURED) -> Column:
    """struct(lat, lon): the place in degrees of a point of the grid."""
    c, turn = grid.constants(), math.radians(grid.grid)
    east, north = x - grid.east, y - grid.north
    v, u = east * math.cos(turn) - north * math.sin(turn), north * math.cos(turn) + east * math.sin(turn)
    q = F.exp(v * (-c["b"] / c["a"]))
    s, big, along = (q - 1 / q) / 2, (q + 1 / q) / 2, u * (c["b"] / c["a"])
    part = (F.sin(along) * c["cos_g"] + s * c["sin_g"]) / big
    t = F.pow(c["h"] / F.sqrt((1 + part) / (1 - part)), F.lit(1 / c["b"]))
    chi = F.lit(math.pi / 2) - 2 * F.atan(t)
    phi = chi
    for n, factors in SERIES.items():
        phi = phi + F.sin(n * chi) * sum(k * grid.e2 ** (i + 1) for i, k in enumerate(factors))
    lon = F.lit(c["lon"]) - F.atan2(s * c["cos_g"] - F.sin(along) * c["sin_g"], F.cos(along)) / c["b"]
    return F.struct(F.degrees(phi).alias("lat"), F.degrees(lon).alias("lon"))


def convergence(lat: Column, lon: Column, grid: Oblique = MEASURED) -> Column:
    """The true bearing of grid north at a place, in degrees: a true bearing less this is the grid bearing of the same line."""
    here, there = to_grid(lat - STEP, lon, grid), to_grid(lat + STEP, lon, grid)
    return -F.degrees(F.atan2(there["x"] - here["x"], there["y"] - here["y"]))
