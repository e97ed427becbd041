"""Sources and sinks on small files: what is written comes back, and the awkward rows are dropped or kept as documented."""

import hashlib
import json
from datetime import datetime

import numpy as np
from pyspark.sql import types as T

from tidemark.sinks import files as sinks
from tidemark.sinks import records
from tidemark.sources import files


def test_jsonl_is_ordered_and_read_again(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, None), (2, "b")], "id long, name string").repartition(3)
    sinks.write_jsonl(df, f"{tmp_path}/out", ["id"])
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"id":1,"name":null}', '{"id":2,"name":"b"}', '{"id":3,"name":"c"}']
    (tmp_path / "in.jsonl").write_text("\n".join([lines[0], "", "  ", "broken", lines[2]]))
    got = files.jsonl(spark, f"{tmp_path}/in.jsonl", T.StructType.fromDDL("id long, name string")).collect()
    assert sorted(map(tuple, got), key=str) == [(1, None), (3, "c"), (None, None)]


def test_features_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [], "b"), (3, None, None)], "id long, xy array<double>, name string").coalesce(1)
    sinks.write_features(df, f"{tmp_path}/geo", "Point", "xy", ["id", "name"])
    (part,) = (tmp_path / "geo").glob("part-*")
    assert json.loads(part.read_text()) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"id": 1, "name": "a"}}
    got = {r.file: (r.bytes, r.sha256) for r in sinks.manifest(spark, f"{tmp_path}/geo").collect()}
    assert got[part.name] == (part.stat().st_size, hashlib.sha256(part.read_bytes()).hexdigest())


def test_replaced_folder_and_newest_version(spark, tmp_path):
    for n in (1, 2):
        sinks.replace_folder(spark.range(n), f"{tmp_path}/t")
        assert spark.read.parquet(f"{tmp_path}/t").count() == n
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    for day, n in (("2024-01-01", 1), ("2024-02-01", 2), ("2024-03-01", 3)):
        spark.range(n).write.parquet(f"{tmp_path}/v/run_date={day}")
    assert [files.newest_version(spark, f"{tmp_path}/v", d).count() for d in ("2024-02-15", "2024-03-01", "2023-01-01")] == [2, 3, 0]


def test_raster_cells(spark, tmp_path):
    values = np.arange(12, dtype="<f4").reshape(3, 4) - 5
    values[0, 0] = -9999
    (tmp_path / "g.flt").write_bytes(values.tobytes())
    (tmp_path / "g.hdr").write_text("ncols 4\nnrows 3\nxllcorner -86.0\nyllcorner 42.0\ncellsize 0.5\nNODATA_value -9999\nbyteorder LSBFIRST\n")
    got = {(r.row, r.col): (r.lon, r.lat, r.elevation) for r in files.grid(spark, str(tmp_path), 2).collect()}
    assert len(got) == 11 and got[0, 1] == (-85.25, 43.25, -4.0) and got[2, 3] == (-84.25, 42.25, 6.0)


def test_station_history(spark, tmp_path):
    (tmp_path / "45007.txt").write_text("#YY MM DD hh mm WDIR WSPD GST WVHT\n2024 1 5 06 50 210 6.5 MM 0.4\n2024 13 5 06 50 210 1 1 1\n2024 01 05 05 50 MM 0.0 1.0 MM\n")
    got = sorted(map(tuple, files.station_history(spark, str(tmp_path)).collect()), key=str)
    assert got == [("45007", datetime(2024, 1, 5, 5, 50), None, 0.0, 1.0, None), ("45007", datetime(2024, 1, 5, 6, 50), 210.0, 6.5, None, 0.4)]


def test_union_of_files(spark, tmp_path):
    for n, name in enumerate(("a", "b")):
        (tmp_path / f"{name}.csv").write_text(f"id|x\n{n}|{name}\n")
    got = files.union_of(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], "csv", {"id": "cast(id as int)", "name": "upper(x)"}, sep="|", header="true")
    assert sorted(map(tuple, got.collect())) == [(0, "A"), (1, "B")]


def test_records_of_cut_and_empty_blobs(spark):
    p = spark.createDataFrame([(7, -86.5, 42.25, 65535, 3, [5.0 * i for i in range(16)], [1e9, -4.0, *[14.9] * 6])], "k long, lon double, lat double, depth_dm int, label int, fetch_m array<double>, run_ft array<double>")
    raw = bytes(records.packed(p, ["k"]).first().record)
    assert len(raw) == 60
    blobs = spark.createDataFrame([(1, raw * 2 + b"cut"), (2, b""), (3, None)], "k long, blob binary")
    got = records.unpacked(blobs, ["k"], "blob").collect()
    assert [(r.k, r.n, r.lon, r.lat, r.depth_dm, r.label) for r in got] == [(1, 0, -86.5, 42.25, 65535, 3), (1, 1, -86.5, 42.25, 65535, 3)]
    assert got[0].run_ft == [655350.0, 0.0, *[10.0] * 6] and got[0].fetch_m[:4] == [0.0, 10.0, 10.0, 20.0]
