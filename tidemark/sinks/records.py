"""Fixed 60-byte records of wave points: packing, unpacking and the index of where each key's records stand."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the record, little-endian.
RECORD = np.dtype([("lon", "<f4"), ("lat", "<f4"), ("depth_dm", "<u2"), ("label", "<u2"), ("fetch", "<u2", 16), ("run", "<u2", 8)])
UNIT_M, UNIT_FT = 10.0, 10.0


def units(values: np.ndarray, unit: float) -> np.ndarray:
    """Whole units of measures, halves up, within 16 bits; 0 where there is no number."""
    return np.fmin(np.fmax(np.floor(values / unit + 0.5), 0), 0xFFFF).astype(np.uint16)


def packed(points: DataFrame, keys: list[str], ends: Sequence[int] | None = None) -> DataFrame:
    """(keys, record): lon, lat, depth_dm, label, fetch_m (16) and run_ft (8) of each point as 60 bytes; with the last keys of ranges, in order, also `_range`, the number of the first key's."""
    measures = [F.col(name).cast("array<double>").alias(alias) for name, alias in (("fetch_m", "fetch"), ("run_ft", "run"))]
    rows = points.select(*keys, F.col("lon").cast("float"), F.col("lat").cast("float"), "depth_dm", "label", *measures)
    last = None if ends is None else np.array(ends, np.int64)

    def run(batches):
        for b in batches:
            out = np.zeros(len(b), RECORD)
            for name in RECORD.names:
                column = b.column(name)
                if name in ("fetch", "run"):
                    out[name] = units(column.flatten().to_numpy(zero_copy_only=False), UNIT_M if name == "fetch" else UNIT_FT).reshape(len(b), -1)
                else:
                    out[name] = column.to_numpy()
            places = pa.array(np.arange(len(b) + 1, dtype=np.int32) * RECORD.itemsize)
            record = pa.Array.from_buffers(pa.binary(), len(b), [None, places.buffers()[1], pa.py_buffer(out.tobytes())])
            more = [] if last is None else [pa.array(np.searchsorted(last, b.column(keys[0]).cast(pa.int64()).fill_null(0).to_numpy()).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), record, *more], [*keys, "record", *(["_range"] if more else [])])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, record binary" + ("" if last is None else ", _range int"))


def unpacked(blobs: DataFrame, keys: list[str], blob: str) -> DataFrame:
    """(keys, n, lon, lat, depth_dm, label, fetch_m, run_ft) of each record in binaries of any number of them; a cut one at the end is left out."""
    kinds = ", ".join(f"`{k}` {blobs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for b in batches:
            raws = [x or b"" for x in b.column(blob).to_pylist()]
            n = np.array([len(x) // 60 for x in raws], np.int64)
            r = np.frombuffer(b"".join(x[: k * 60] for x, k in zip(raws, n, strict=True)), RECORD)
            whose = np.repeat(np.arange(len(n)), n)
            place = (np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            lists = lambda v, unit: pa.FixedSizeListArray.from_arrays(pa.array(v.astype(float).ravel() * unit), v.shape[1]).cast(pa.list_(pa.float64()))
            plain = [pa.array(r[name].astype(t)) for name, t in (("lon", float), ("lat", float), ("depth_dm", np.int32), ("label", np.int32))]
            cols = [*(b.column(k).take(pa.array(whose)) for k in keys), pa.array(place), *plain, lists(r["fetch"], UNIT_M), lists(r["run"], UNIT_FT)]
            yield pa.RecordBatch.from_arrays(cols, [*keys, "n", "lon", "lat", "depth_dm", "label", "fetch_m", "run_ft"])

    return blobs.select(*keys, blob).mapInArrow(run, f"{kinds}, n int, lon double, lat double, depth_dm int, label int, fetch_m array<double>, run_ft array<double>")


def offsets(rows: DataFrame, key: str) -> DataFrame:
    """(key, first, count): where a key's rows begin when all are written in the order of the keys.

    Keys are dealt by range; only one total a partition meets in one place, and the running count within a partition is a window over it alone.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("count")).repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    totals = counts.groupBy("_p").agg(F.sum("count").alias("_t"), F.min(key).alias("_k"))
    before = F.sum("_t").over(Window.orderBy("_k")) - F.col("_t")
    starts = F.broadcast(totals.select(F.col("_k").alias("_from"), F.lead("_k").over(Window.orderBy("_k")).alias("_to"), before.alias("_before")))
    placed = counts.drop("_p").join(starts, (F.col(key) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(key) < F.col("_to"))))
    inside = F.sum("count").over(Window.partitionBy("_from").orderBy(key)) - F.col("count")
    return placed.select(key, (F.col("_before") + inside).alias("first"), "count")
