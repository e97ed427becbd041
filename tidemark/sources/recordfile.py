"""Files of 60-byte records as a Spark data source: the records of a key stand together, an index beside each file tells where, and a read of some keys touches no more than their slices.

A folder holds `part-*.bin` with nothing but records, `part-*.idx` with a row (key, first, count) of 20 bytes for each of its keys, in the order of the keys, and `files.json`
with the least and greatest key and the number of records of each part, which is written last: a folder without it is no table. Any file system that Arrow knows will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidemark.sinks import records

NAME = "tidemark_records"
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1
INDEX = np.dtype([("key", "<i8"), ("first", "<i8"), ("count", "<i4")])
SCHEMA = "key long, n int, lon double, lat double, depth_dm int, label int, fetch_m array<double>, run_ft array<double>"
#: Records that one task reads, about, that one Arrow batch holds, at most, and after which a part ends with the key.
SPLIT, BATCH, PART = 2 << 20, 20_000, 1 << 20
#: Ranges of keys that `write_points` tells apart; it joins neighbours of these into parts.
FINEST = 1024


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """The parts that a task wrote: (least key, greatest key, name, records)."""

    parts: list[tuple[int, int, str, int]]


@dataclass
class Slice(InputPartition):
    """Of a part the keys whose records begin from number `first` to before number `last`."""

    name: str
    first: int
    last: int


class _Part:
    """A part as it is written."""

    def __init__(self, where: fs.FileSystem, root: str):
        self.where, self.at, self.name = where, root, f"part-{uuid.uuid4().hex}"
        self.out = where.open_output_stream(f"{root}/{self.name}.bin")
        self.keys, self.begins, self.records = [], [], 0

    def add(self, key: np.ndarray, record: pa.Array) -> None:
        """Rows after those before: keys in order, and 60 bytes each."""
        begins = np.flatnonzero(np.concatenate([[self.records == 0 or key[0] != self.keys[-1][-1]], key[1:] != key[:-1]]))
        if len(begins):
            self.keys.append(key[begins])
            self.begins.append(begins + self.records)
        fixed, size = record.cast(pa.binary(records.RECORD.itemsize)), records.RECORD.itemsize
        self.out.write(fixed.buffers()[1].slice(fixed.offset * size, len(fixed) * size))
        self.records += len(key)

    def close(self) -> tuple[int, int, str, int]:
        self.out.close()
        keys, first = np.concatenate(self.keys), np.concatenate(self.begins)
        index = np.zeros(len(keys), INDEX)
        index["key"], index["first"], index["count"] = keys, first, np.diff(first, append=self.records)
        with self.where.open_output_stream(f"{self.at}/{self.name}.idx") as out:
            out.write(index.tobytes())
        return int(keys[0]), int(keys[-1]), self.name, self.records


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = _at(self.path)
        where.create_dir(root, recursive=True)
        parts, part, last = [], None, None
        for batch in iterator:
            key, record = batch.column("key"), batch.column("record")
            if key.null_count or record.null_count or not pc.all(pc.equal(pc.binary_length(record), records.RECORD.itemsize)).as_py():
                raise ValueError("a record needs a key and 60 bytes")
            key = key.to_numpy()
            if len(key) == 0:
                continue
            if (key[1:] < key[:-1]).any() or (last is not None and key[0] < last):
                raise ValueError("rows must come in the order of their keys; use write_records")
            same = int(np.searchsorted(key, last, "right")) if last is not None else 0
            if same:  # a key's records stay together
                part.add(key[:same], record[:same])
            if same < len(key):
                if part is not None and part.records >= PART:
                    parts.append(part.close())
                    part = None
                part = part or _Part(where, root)
                part.add(key[same:], record[same:])
            last = key[-1]
        return Written(parts + ([part.close()] if part else []))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, root = _at(self.path)
        parts = sorted(p for m in messages if isinstance(m, Written) for p in m.parts)
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/files.json") as out:
            out.write(json.dumps([{"name": n, "low": low, "high": high, "records": r} for low, high, n, r in parts]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, root = _at(self.path)
        for _, _, name, _ in (p for m in messages if isinstance(m, Written) for p in m.parts):
            for end in ("bin", "idx"):
                where.delete_file(f"{root}/{name}.{end}")


class RecordReader(DataSourceReader):
    def __init__(self, path: str, low: int = LEAST, high: int = GREATEST, listed: Iterable[int] | None = None):
        self.path, self.low, self.high = path, low, high
        self.listed = None if listed is None else set(listed)

    def _wanted(self, low: int, high: int) -> bool:
        return self.low <= self.high and low <= self.high and high >= self.low and (self.listed is None or any(low <= k <= high for k in self.listed))

    def partitions(self) -> Sequence[Slice]:
        where, root = _at(self.path)
        with where.open_input_stream(f"{root}/files.json") as f:
            parts = json.loads(f.read())
        return [Slice(p["name"], i, i + SPLIT) for p in parts if self._wanted(p["low"], p["high"]) for i in range(0, p["records"], SPLIT)]

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        where, root = _at(self.path)
        with where.open_input_stream(f"{root}/{partition.name}.idx") as f:
            index = np.frombuffer(f.read(), INDEX)
        index = index[(index["first"] >= partition.first) & (index["first"] < partition.last) & (index["key"] >= self.low) & (index["key"] <= self.high)]
        if self.listed is not None:
            index = index[np.isin(index["key"], np.array(sorted(self.listed), np.int64))]
        if len(index) == 0:
            return
        key, begin, count = (index[c].astype(np.int64) for c in ("key", "first", "count"))
        end = begin + count
        apart = np.flatnonzero(begin[1:] != end[:-1]) + 1  # keys whose records follow each other are read at once
        with where.open_input_file(f"{root}/{partition.name}.bin") as f:
            for first, last in zip(begin[[0, *apart]].tolist(), end[[*(apart - 1), len(end) - 1]].tolist(), strict=True):
                f.seek(first * records.RECORD.itemsize)
                for i in range(first, last, BATCH):
                    at = np.arange(i, min(i + BATCH, last))
                    row = np.searchsorted(begin, at, "right") - 1
                    yield _batch(key[row], at - begin[row], np.frombuffer(f.read(len(at) * records.RECORD.itemsize), records.RECORD))


def _batch(key: np.ndarray, n: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
    lists = lambda v, unit: pa.FixedSizeListArray.from_arrays(pa.array(v.astype(float).ravel() * unit), v.shape[1]).cast(pa.list_(pa.float64()))
    columns = [pa.array(key), pa.array(n.astype(np.int32)), *(pa.array(r[c].astype(t)) for c, t in (("lon", float), ("lat", float), ("depth_dm", np.int32), ("label", np.int32)))]
    return pa.RecordBatch.from_arrays([*columns, lists(r["fetch"], records.UNIT_M), lists(r["run"], records.UNIT_FT)], ["key", "n", "lon", "lat", "depth_dm", "label", "fetch_m", "run_ft"])


class RecordSource(DataSource):
    """Reads `SCHEMA`; writes (key long, record binary), each task's rows in the order of their keys."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> RecordReader:
        o = self.options
        return RecordReader(o["path"], int(o.get("low", LEAST)), int(o.get("high", GREATEST)), json.loads(o["keys"]) if "keys" in o else None)

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"])


def _write(rows: DataFrame, key: str, path: str, order: Sequence[Column | str]) -> None:
    rows.sparkSession.dataSource.register(RecordSource)
    rows.sortWithinPartitions(key, *order).select(F.col(key).cast("long").alias("key"), "record").write.format(NAME).mode("append").save(path)


def write_points(points: DataFrame, key: str, path: str, order: Sequence[str] = (), parts: int | None = None) -> None:
    """Pack points (as `records.packed` takes them) and write them to a new folder: dealt by ranges of the key (`parts`, if given; 1,024 at most), in its order (then `order`).

    The ranges come from the keys alone, as approximate percentiles of all of them, and each point is packed once; `repartitionByRange` would pack every point
    a first time for the keys that it looks at. The ranges say only how even the parts are; whatever they are, all records of a key are in one part.
    """
    whole = F.col(key).cast("long")
    found = points.select(whole.alias("k")).agg(F.count("*").alias("n"), F.percentile_approx("k", [i / FINEST for i in range(1, FINEST)], 10_000).alias("k")).first()
    some = parts or max(-(-found.n // PART), min(points.sparkSession.sparkContext.defaultParallelism, -(-found.n // BATCH)))
    some = min(max(some, 1), FINEST)
    ends = sorted({found.k[i * FINEST // some - 1] for i in range(1, some)}) if found.k else []
    rows = records.packed(points.withColumn(key, whole), list(dict.fromkeys([key, *order])), ends)
    _write(rows.repartitionById(len(ends) + 1, "_range"), key, path, order)


def write_records(packed: DataFrame, key: str, path: str, order: Sequence[Column] = (), parts: int | None = None) -> None:
    """Write packed records (key, record) to a new folder: dealt by ranges of the key (into `parts`, if given), in its order (then `order`), so each key's records
    stand together in one part."""
    _write(packed.repartitionByRange(*([parts] if parts else []), key), key, path, order)


def read_records(spark: SparkSession, path: str, low: int = LEAST, high: int = GREATEST, keys: Iterable[int] | None = None) -> DataFrame:
    """The records of a folder as rows of `SCHEMA`, n numbering those of a key; with bounds or a list of keys, only the parts and slices of those keys are read.

    The keys are options of the source and not filters that Spark pushes down: its Python sources keep what was pushed, so two filters over one frame would both count.
    """
    spark.dataSource.register(RecordSource)
    reader = spark.read.format(NAME).option("low", str(low)).option("high", str(high))
    return (reader if keys is None else reader.option("keys", json.dumps(sorted(set(keys))))).load(path)
