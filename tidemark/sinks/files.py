"""Writers: ordered JSON lines, GeoJSON features, manifests, replaced folders. All write in parallel with Spark's committer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, order: list[str], nulls: bool = True) -> None:
    """One JSON object a line in the columns' order; rows ascend by `order` within a file and from file to file."""
    lines = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false" if nulls else "true"})
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(lines.alias("value")).write.mode("overwrite").text(path)


def feature(geometry_type: str, coordinates: Column, properties: list[str]) -> Column:
    """A GeoJSON feature as text; null for a null or empty geometry."""
    shape = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    return F.when(F.size(coordinates) > 0, F.to_json(shape, {"ignoreNullFields": "false"}))


def write_features(df: DataFrame, path: str, geometry_type: str, coordinates: str, properties: list[str]) -> None:
    """GeoJSON text sequences, a feature a line, empty geometries skipped. A collection in one file would pass everything through one task."""
    df.select(feature(geometry_type, F.col(coordinates), properties).alias("value")).where("value is not null").write.mode("overwrite").text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files below a path, markers and hidden ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def replace_folder(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write beside `path`, then take its place by renames: a reader sees the old or the new table, and a failed job leaves the old one."""
    spark = df.sparkSession
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").format(form).save(new)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(old), True)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"can't move {path}")
    if not fs.rename(at(new), at(path)):
        raise OSError(f"can't move {new}")
    fs.delete(at(old), True)
