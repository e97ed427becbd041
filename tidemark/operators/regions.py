"""Points of waters by region, rasters of depth, and series by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geo

#: Cells that a point may look around itself for water, and the decimetres that mean unknown.
SNAP_CELLS, UNKNOWN_DM = 2, 0xFFFF


def centroids(points: DataFrame, keys: list[str], degrees: float) -> DataFrame:
    """(keys, lat, lon, cell_lat, cell_lon, n): mean place of each group of points and the cell it lies in."""
    out = points.groupBy(*keys).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n"))
    return out.withColumn("cell_lat", geo.cell(F.col("lat"), degrees)).withColumn("cell_lon", geo.cell(F.col("lon"), degrees))


def supported(points: DataFrame, key: str, label: str, least: int = 2) -> DataFrame:
    """`points` where labels that fewer than `least` points of a key hold are null. Counts are aggregated, not windowed, so no key's points are gathered."""
    rare = points.groupBy(key, label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key, label, F.lit(True).alias("_ok"))
    return points.join(rare, [key, label], "left").withColumn(label, F.when(F.col("_ok"), F.col(label))).drop("_ok")


def reachable(points: DataFrame, keys: list[str], lat: float, lon: float, nm: float) -> DataFrame:
    """(keys, nm): groups of which any point lies within `nm`, with the least distance."""
    return points.groupBy(*keys).agg(F.min(geo.distance_nm(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).alias("nm")).where(F.col("nm") <= nm)


def depths(points: DataFrame, cells: DataFrame, snap: int = SNAP_CELLS) -> DataFrame:
    """`points` (row, col, lat, id) with depth_m: that of their own cell of `cells` (row, col, elevation), else of the nearest wet one within `snap` cells.

    Wet cells lie below 0; distances are in cells north to south, shrunk by the latitude from east to west; of cells as near the deepest counts. Only
    points without a wet cell of their own look around, by equality on the cells that they may use.
    """
    wet = cells.where(F.col("elevation") < 0).select(F.col("row").alias("_r"), F.col("col").alias("_c"), (-F.col("elevation")).alias("_d"))
    own = points.join(wet, (F.col("row") == F.col("_r")) & (F.col("col") == F.col("_c")), "left").drop("_r", "_c").withColumnRenamed("_d", "depth_m")
    lost = own.where("depth_m is null").select("id", "row", "col", "lat").distinct()
    offsets = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(-snap, snap + 1) for c in range(-snap, snap + 1) if (r, c) != (0, 0)]))
    around = lost.select("id", "lat", "row", "col", offsets.alias("o"))
    met = around.join(wet, (F.col("row") + F.col("o.r") == F.col("_r")) & (F.col("col") + F.col("o.c") == F.col("_c")))
    away = F.round(F.sqrt(F.pow(F.col("o.r").cast("double"), 2) + F.pow(F.col("o.c") * F.cos(F.radians("lat")), 2)), 9)
    near = met.groupBy("id").agg(F.min_by("_d", F.struct(away, -F.col("_d"))).alias("_near"))
    return own.join(near, "id", "left").withColumn("depth_m", F.coalesce("depth_m", "_near")).drop("_near")


def decimetres(depth_m: Column) -> Column:
    """Whole decimetres, halves up; UNKNOWN_DM where the depth is null or no water."""
    return F.when(depth_m > 0, F.least(F.floor(depth_m * 10 + 0.5), F.lit(UNKNOWN_DM - 1))).otherwise(UNKNOWN_DM).cast("int")


def with_forecast(points: DataFrame, series: DataFrame, cell: list[str], hour: str) -> DataFrame:
    """`points` (with cell columns) with every hour of their cell's series; cells without one drop out."""
    return points.join(series, cell)


def marine(points: DataFrame, hours: DataFrame, cell: list[str], most_nm: float = 10.0) -> DataFrame:
    """Points with the marine hours of their cell, where the model's own place (at_lat, at_lon) is not more than `most_nm` away."""
    met = points.join(hours, cell)
    return met.where(geo.distance_nm(F.col("lat"), F.col("lon"), F.col("at_lat"), F.col("at_lon")) <= most_nm)


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, least, median, mean, most, total); the median is a value that occurs, the lower of two."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}`)").alias("median"), F.avg(v).alias("mean"), F.max(v).alias("most"), F.sum(v).alias("total"))


def arc_means(rays: Column, per_bin: int = 5) -> Column:
    """Means of `per_bin` rays in a row for each bin of an array of rays."""
    bins = F.sequence(F.lit(0), (F.size(rays) / per_bin).cast("int") - 1)
    return F.transform(bins, lambda b: F.aggregate(F.slice(rays, b * per_bin + 1, F.lit(per_bin)), F.lit(0.0), lambda a, x: a + x) / per_bin)
