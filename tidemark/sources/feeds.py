"""Readers of observation and record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the buoys' table, in order, and knots in a metre a second.
BUOY = "STN LAT LON YYYY MM DD hh mm WDIR WSPD GST WVHT DPD APD MWD PRES PTDY ATMP WTMP DEWP VIS TIDE".split()
MS_TO_KT = 1.943844


def buoys(spark: SparkSession, path: str) -> DataFrame:
    """Latest buoy observations: station, lat, lon, at, wind_dir, wind_kt, gust_kt, wave_m. `MM` and unreadable numbers are null; short lines and comments are dropped."""
    cols = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("value <> '' and value not like '#%'").select(cols.alias("c")).where(F.size("c") >= 12)
    num = lambda name: F.col("c")[BUOY.index(name)].try_cast("double")
    at = F.try_to_timestamp(F.array_join(F.slice("c", 4, 5), "-"), F.lit("yyyy-MM-dd-HH-mm"))
    return rows.select(F.col("c")[0].alias("station"), num("LAT").alias("lat"), num("LON").alias("lon"), at.alias("at"), num("WDIR").alias("wind_dir"), (num("WSPD") * MS_TO_KT).alias("wind_kt"), (num("GST") * MS_TO_KT).alias("gust_kt"), num("WVHT").alias("wave_m"))


def gazetteer(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """(name, class, lat, lon) of a pipe-delimited gazetteer; rows of other classes or without a position are dropped."""
    fields = ["feature_name", "feature_class", "prim_lat_dec", "prim_long_dec"]
    rows = spark.read.option("sep", "|").option("header", True).csv(path).select(*fields).toDF("name", "class", "lat", "lon")
    rows = rows.where(F.col("class").isin(classes)).withColumn("lat", F.col("lat").try_cast("double")).withColumn("lon", F.col("lon").try_cast("double"))
    return rows.where("lat is not null and lon is not null and lat <> 0")


def features(spark: SparkSession, path: str, properties: T.StructType) -> DataFrame:
    """The features of GeoJSON collections: the named properties, then `ring` (outer ring as array<struct<x, y>>) of polygons."""
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", properties), T.StructField("geometry", geometry)])))])
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return rows.select("f.properties.*", F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))


def hourly(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Hourly forecasts of aligned arrays as rows: lat, lon, at (UTC), then the fields. The shortest array ends a series."""
    kinds = ", ".join(["time: array<string>", *[f"{f}: array<double>" for f in fields]])
    raw = spark.read.schema(f"latitude double, longitude double, utc_offset_seconds int, hourly struct<{kinds}>").option("multiLine", True).json(path)
    rows = raw.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "utc_offset_seconds", F.explode(F.arrays_zip(F.col("hourly.time").alias("time"), *[F.col(f"hourly.{f}").alias(f) for f in fields])).alias("h"))
    at = F.timestamp_seconds(F.unix_timestamp("h.time", "yyyy-MM-dd'T'HH:mm") - F.coalesce("utc_offset_seconds", F.lit(0)))
    return rows.select("lat", "lon", at.alias("at"), *[F.col(f"h.{f}").alias(f) for f in fields]).where("at is not null")
