"""Wind components, runway ends, altitudes and units as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: hectopascals in an inch of mercury.
HPA_PER_INHG = 33.8638866667


def crosswind(wind_dir: Column, wind_kt: Column, heading: Column) -> Column:
    """Signed crosswind, positive from the right."""
    return wind_kt * F.sin(F.radians(wind_dir - heading))


def headwind(wind_dir: Column, wind_kt: Column, heading: Column) -> Column:
    return wind_kt * F.cos(F.radians(wind_dir - heading))


def runway_ends(runways: Column) -> Column:
    """array<struct<id, heading, length_ft>>: both ends of each element struct(id, heading, length_ft), the first-named one first.

    A strip with one name gets `<name> rev` for its other end; one without a name is called by its heading.
    """

    def both(r: Column) -> Column:
        heading = F.bround(r["heading"].cast("double")).cast("int")
        names = F.filter(F.transform(F.split(F.coalesce(r["id"], F.lit("")), "/"), lambda x: F.trim(x)), lambda x: x != "")
        first = F.coalesce(F.get(names, F.lit(0)), F.lpad(heading.cast("string"), 3, "0"))
        other = F.coalesce(F.get(names, F.lit(1)), F.concat(first, F.lit(" rev")))
        end = lambda name, turn: F.struct(name.alias("id"), F.pmod(heading + turn, F.lit(360)).alias("heading"), r["length_ft"].alias("length_ft"))
        return F.array(end(first, 0), end(other, 180))

    return F.flatten(F.transform(runways, both))


def best_end(ends: Column, wind_dir: Column, wind_kt: Column) -> Column:
    """The end with the least crosswind (to 0.001 kt), then the most headwind, then the longest, then the first; in calm air the longest."""

    def ranked(e: Column, i: Column) -> Column:
        calm = F.coalesce(wind_kt <= 0, F.lit(True))
        heading = e["heading"].cast("double")
        return F.struct(
            F.when(calm, F.lit(0.0)).otherwise(F.bround(F.abs(crosswind(wind_dir, wind_kt, heading)), 3)).alias("across"),
            F.when(calm, F.lit(0.0)).otherwise(-headwind(wind_dir, wind_kt, heading)).alias("along"),
            (-F.coalesce(e["length_ft"].cast("double"), F.lit(0.0))).alias("length"), i.alias("place"), e.alias("end"),
        )

    return F.array_min(F.transform(ends, ranked))["end"]


def pressure_altitude_ft(elevation_ft: Column, altimeter_inhg: Column) -> Column:
    return elevation_ft + (F.lit(29.92) - altimeter_inhg) * 1000.0


def density_altitude_ft(elevation_ft: Column, altimeter_inhg: Column, temp_c: Column) -> Column:
    pa = pressure_altitude_ft(elevation_ft, altimeter_inhg)
    return pa + 120.0 * (temp_c - (F.lit(15.0) - 2.0 * pa / 1000.0))


def f_to_c(f: Column) -> Column:
    return (f - 32.0) * 5.0 / 9.0


def c_to_f(c: Column) -> Column:
    return c * 9.0 / 5.0 + 32.0


def hpa_to_inhg(hpa: Column) -> Column:
    return hpa / F.lit(HPA_PER_INHG)
