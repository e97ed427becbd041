"""Files of the batch side: JSON lines, newest versions, rasters, station histories, indexes of pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a file of JSON lines; blank lines are skipped, broken ones give a row of nulls."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def newest_version(spark: SparkSession, base: str, upto: str, form: str = "parquet") -> DataFrame:
    """The table below `base/run_date=...` of the newest date up to `upto`. Dates come from the folders; other versions are pruned, not read."""
    every = spark.read.format(form).option("basePath", base).load(base)
    day = F.col("run_date").cast("string")
    fs = spark._jvm.org.apache.hadoop.fs.Path(base)
    found = [x.getPath().getName().partition("=") for x in fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs)]
    dates = sorted(v for k, _, v in found if k == "run_date" and v <= upto)
    return every.where(day == dates[-1]) if dates else every.where(F.lit(False))


def union_of(spark: SparkSession, paths: list[str], form: str, columns: dict[str, str], **options: str) -> DataFrame:
    """The files of several states or layers as one table: name -> expression for each column, from each file by itself."""
    parts = [spark.read.format(form).options(**options).load(p).select(*[F.expr(e).alias(n) for n, e in columns.items()]) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grid(spark: SparkSession, path: str, rows_a_step: int = 64) -> DataFrame:
    """(name, row, col, lon, lat, elevation) of the cells of ESRI .flt rasters with .hdr beside them, missing values left out.

    Each raster is one task; its cells leave it some rows at a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{flt,hdr}").load(path)
    stem = F.regexp_extract("path", r"([^/]+)\.(flt|hdr)$", 1).alias("name")
    heads = files.where(F.col("path").endswith(".hdr")).select(stem, F.col("content").cast("string").alias("head"))
    both = files.where(F.col("path").endswith(".flt")).select(stem, "content").join(heads, "name")

    def run(batches):
        for b in batches:
            for name, raw, head in zip(b.column("name").to_pylist(), b.column("content"), b.column("head").to_pylist(), strict=True):
                h = {k.lower(): v for k, v in (x.split()[:2] for x in head.splitlines() if len(x.split()) > 1)}
                n, m, size = int(h["nrows"]), int(h["ncols"]), float(h["cellsize"])
                order = "<" if h.get("byteorder", "LSBFIRST").upper().startswith("LSB") else ">"
                values = np.frombuffer(raw.as_buffer(), f"{order}f4").reshape(n, m)
                left, low = (float(h.get(f"{a}llcenter", float(h.get(f"{a}llcorner", 0)) + size / 2)) for a in "xy")
                for first in range(0, n, rows_a_step):
                    part = values[first : first + rows_a_step]
                    r, c = np.nonzero(part != float(h.get("nodata_value", -9999)))
                    cols = [pa.array([name] * len(r)), pa.array((r + first).astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(left + c * size), pa.array(low + (n - 1 - first - r) * size), pa.array(part[r, c].astype(float))]
                    yield pa.RecordBatch.from_arrays(cols, ["name", "row", "col", "lon", "lat", "elevation"])

    return both.mapInArrow(run, "name string, row int, col int, lon double, lat double, elevation double")


def station_history(spark: SparkSession, path: str) -> DataFrame:
    """(station, at, dir_deg, speed_ms, gust_ms, wave_m) of tables of one station a file (its name), `MM` null; rows without a valid date are dropped."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(F.regexp_extract(F.input_file_name(), r"([^/.]+)\.[^/]*$", 1).alias("station"), F.split(F.trim("value"), r"\s+").alias("f"))
    number = lambda i: F.get("f", F.lit(i)).try_cast("double")
    text = lambda i: F.lpad(F.get("f", F.lit(i)), 2, "0")
    at = F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", F.get("f", F.lit(0)), text(1), text(2)), F.concat_ws(":", text(3), text(4))), F.lit("yyyy-MM-dd HH:mm"))
    return lines.select("station", at.alias("at"), number(5).alias("dir_deg"), number(6).alias("speed_ms"), number(7).alias("gust_ms"), number(8).alias("wave_m")).where("at is not null")


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, slug, url, name): the first link of each page to each slug, in order of places."""
    anchors = F.regexp_extract_all(html, F.lit(r'(?is)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    each = pages.select(key, F.posexplode(anchors).alias("place", "a"))
    url = F.regexp_extract("a", r'(?i)href="([^"]*)"', 1)
    each = each.select(key, "place", url.alias("url"), F.trim(F.regexp_replace(F.regexp_replace("a", "<[^>]*>", " "), r"\s+", " ")).alias("name"))
    each = each.withColumn("slug", F.regexp_extract(F.regexp_replace("url", r"[?#].*$|/+$", ""), r"([^/]*)$", 1)).where("slug <> ''")
    return each.groupBy(key, "slug").agg(F.min(F.struct("place", "url", "name")).alias("f")).select(key, "f.place", "slug", "f.url", "f.name")
