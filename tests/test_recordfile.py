"""Record files: what is written comes back, keys stand together, and a read of some keys touches only their slices."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.sinks import records
from tidemark.sources import recordfile


def points(spark, n=500):
    fetch, run = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: i * 100.0), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i * 20.0)
    base = spark.range(n).select((F.col("id") * 7 % 40).alias("k"), F.col("id").alias("i"), (F.col("id") / 8).alias("lon"), F.lit(45.5).alias("lat"), F.col("id").cast("int").alias("depth_dm"), (F.col("id") % 5).cast("int").alias("label"))
    return base.withColumns({"fetch_m": fetch, "run_ft": run}).repartition(6)


def test_round_trip_and_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(recordfile, "SPLIT", 30)
    p = points(spark)
    path = f"{tmp_path}/wave"
    recordfile.write_records(records.packed(p, ["k", "i"]), "k", path, [F.col("i")], 4)
    got = recordfile.read_records(spark, path)
    want = sorted((r.k, r.depth_dm, r.lon) for r in p.collect())
    assert sorted((r.key, r.depth_dm, r.lon) for r in got.collect()) == want
    by_key = got.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "depth_dm"))).alias("d")).collect()
    assert all([x.n for x in r.d] == list(range(len(r.d))) and [x.depth_dm for x in r.d] == sorted(x.depth_dm for x in r.d) for r in by_key)
    some = lambda **k: sorted((r.key, r.depth_dm) for r in recordfile.read_records(spark, path, **k).collect())
    assert some(keys=[7]) == [(k, d) for k, d, _ in want if k == 7] and some(keys=[1, 39, 77], high=20) == [(k, d) for k, d, _ in want if k == 1] and some(low=41) == []
    assert got.where("key > 35 or depth_dm < 3").count() == sum(k > 35 or d < 3 for k, d, _ in want) and got.where("key in (3, 4)").count() == sum(k in (3, 4) for k, _, _ in want)
    assert len(list((tmp_path / "wave").glob("*.bin"))) > 1


def test_keys_prune_parts_and_slices(spark, tmp_path):
    path = f"{tmp_path}/wave"
    recordfile.write_records(records.packed(points(spark), ["k", "i"]), "k", path, parts=4)

    def read(*bounds):
        reader = recordfile.RecordReader(path, *bounds)
        parts = reader.partitions()
        return len(parts), sorted({k for p in parts for b in reader.read(p) for k in b.column("key").to_pylist()})

    every, keys = read()
    assert keys == list(range(40)) and read(11, 11) == (1, [11]) and read(37, 38)[1] == [37, 38] and read(37, 38)[0] < every
    assert read(0, 99, [3, 5, 900])[1] == [3, 5] and read(4, 3) == (0, [])


def test_unordered_rows_and_bad_records_are_refused(spark, tmp_path):
    spark.dataSource.register(recordfile.RecordSource)
    rows = spark.createDataFrame([(2, bytes(60)), (1, bytes(60))], "key long, record binary").coalesce(1)
    with pytest.raises(Exception, match="order of their keys"):
        rows.write.format(recordfile.NAME).mode("append").save(f"{tmp_path}/a")
    with pytest.raises(Exception, match="60 bytes"):
        recordfile.write_records(spark.createDataFrame([(1, b"short")], "k long, record binary"), "k", f"{tmp_path}/b")
    recordfile.write_records(rows.where("key > 5"), "key", f"{tmp_path}/c")
    assert recordfile.read_records(spark, f"{tmp_path}/c").count() == 0


def test_points_are_packed_once_and_kept_together(spark, tmp_path):
    packings = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def depth(v):  # asked for by packing, not by a look at the keys
        packings.add(1)
        return v

    p = points(spark)
    path = f"{tmp_path}/wave"
    recordfile.write_points(p.withColumns({"k": F.col("k") - 20, "depth_dm": depth("depth_dm")}), "k", path, ["i"], 4)
    assert packings.value == 500
    got = recordfile.read_records(spark, path).collect()
    assert sorted((r.key + 20, r.depth_dm, r.lon, r.fetch_m[3], r.run_ft[7]) for r in got) == sorted((r.k, r.depth_dm, r.lon, 300.0, 140.0) for r in p.collect())
    assert all(r.depth_dm == sorted(x.depth_dm for x in got if x.key == r.key)[r.n] for r in got)
    parts = [recordfile.RecordReader(path, k, k).partitions() for k in range(-20, 20)]
    assert all(len(x) == 1 for x in parts) and len({x[0].name for x in parts}) == 4
    recordfile.write_points(p.where("k > 99"), "k", f"{tmp_path}/none")
    assert recordfile.read_records(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="60 bytes"):
        recordfile.write_points(p.withColumn("k", F.when(F.col("i") > 0, F.col("k"))), "k", f"{tmp_path}/null")


def test_parts_stay_short_and_keys_whole(tmp_path, monkeypatch):
    monkeypatch.setattr(recordfile, "PART", 50)
    monkeypatch.setattr(recordfile, "BATCH", 7)
    keys = [recordfile.LEAST, *(k for k in range(120) for _ in range(3)), *[500] * 200, *range(501, 560), recordfile.GREATEST]
    raws = [i.to_bytes(4, "little") + bytes(56) for i in range(len(keys))]
    writer = recordfile.RecordWriter(str(tmp_path))
    batches = (pa.record_batch({"key": pa.array(keys[i : i + 20]), "record": pa.array(raws[i : i + 20], pa.binary())}) for i in range(0, len(keys), 20))
    writer.commit([writer.write(batches)])
    reader = recordfile.RecordReader(str(tmp_path))
    lengths = [sum(len(b) for b in reader.read(p)) for p in reader.partitions()]
    assert len(lengths) > 5 and sum(lengths) == len(keys) and all(n < 50 + 20 + 200 for n in lengths)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in zip(*(b.column(c).to_pylist() for c in ("key", "n", "lon")), strict=True)]
    place = lambda i: i - keys.index(keys[i])
    assert rows == [(k, place(i), float(np.frombuffer(raws[i], "<f4", 1)[0])) for i, k in enumerate(keys)]
    some = recordfile.RecordReader(str(tmp_path), listed=[3, 5, 500])
    assert [k for p in some.partitions() for b in some.read(p) for k in b.column("key").to_pylist()] == [3] * 3 + [5] * 3 + [500] * 200
    assert all(len({p.name for p in recordfile.RecordReader(str(tmp_path), k, k).partitions()}) == 1 for k in set(keys))


def test_measures_without_a_number_are_zero(spark):
    row = (1, 0.0, 0.0, 0, 0, [None, float("nan"), float("inf"), -float("inf"), 5.0, 4.999, *[0.0] * 10], [655345.0, 1e300, *[0.0] * 6])
    p = spark.createDataFrame([row], "k long, lon double, lat double, depth_dm int, label int, fetch_m array<double>, run_ft array<double>")
    got = records.unpacked(records.packed(p, ["k"]), ["k"], "record").first()
    assert got.fetch_m[:6] == [0.0, 0.0, 655350.0, 0.0, 10.0, 0.0] and got.run_ft[:2] == [655350.0, 655350.0]
