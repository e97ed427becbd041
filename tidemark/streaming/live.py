"""Live observations with Structured Streaming: the newest of each key, and counts by window, from files that arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.storage import shared_folder


def _root(spark: SparkSession) -> str:
    """The folder that driver and executors share, for checkpoints and sinks."""
    return shared_folder(spark, "stream")


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet files of `path`, or over the one file."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema)
    rows = reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)
    zoneless = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table is a folder: then the files that Spark lists for it lie below the path."""
    return not spark.read.parquet(path).inputFiles()[0].endswith("/" + path.rpartition("/")[2])


def _drained(out: DataFrame, mode: str, upsert_keys: list[str]) -> DataFrame:
    """Run a stream over what is there now and give its last state: each batch is written to the shared folder; of each key the row of the last batch counts."""
    spark, root = out.sparkSession, _root(out.sparkSession)

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    q = out.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = T.StructType([*out.schema.fields, T.StructField("_batch", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{root}/out/batch=*")
    rest = [c for c in out.columns if c not in upsert_keys]
    return rows.groupBy(*upsert_keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*upsert_keys, "r.*")


def latest(spark: SparkSession, path: str, key: str, ts: str = "ts") -> DataFrame:
    """(key, ts, n): the newest time and the number of observations of each key, kept as streaming state."""
    return _drained(stream(spark, path).groupBy(key).agg(F.max(ts).alias(ts), F.count("*").alias("n")), "update", [key])


def windowed(spark: SparkSession, path: str, key: str, hours: int, ts: str = "ts", late: str = "3 hours") -> DataFrame:
    """(key, block, n): counts by tumbling blocks; observations later than `late` behind the newest are cut by the watermark."""
    rows = stream(spark, path).withWatermark(ts, late).groupBy(key, F.window(ts, f"{hours} hours").alias("w")).agg(F.count("*").alias("n"))
    return _drained(rows.select(key, F.col("w.start").alias("block"), "n"), "update", [key, "block"])
