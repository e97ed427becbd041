"""Work that must not grow faster than its tables: answers held against the plain, one by one ways."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import borders, linkage, matching, overlay, places, reaches, shapes
from tidemark.plans import areas, checks, pages, waters


def rings():
    rng, out = np.random.default_rng(0), []
    for n in range(3, 27):
        turn, far = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(20, 400, n)
        out += [np.column_stack([1000 + far * np.cos(turn), 500 + far * np.sin(turn)]), np.column_stack([90 * np.cos(turn), 60 * np.sin(turn)])]
    return out


def test_reaches_of_many_rings(spark):
    every = rings()
    rows = [(i, [(float(x), float(y)) for x, y in r]) for i, r in enumerate(every)] + [(-1, None), (-2, [(0.0, 0.0), (1.0, 1.0)])]
    df = spark.createDataFrame(rows, "i int, ring array<struct<x: double, y: double>>")
    got = {r["i"]: r for r in df.select("i", reaches.reaches()("ring")["length"].alias("r"), reaches.reaches(sweep=False)("ring")["length"].alias("c")).collect()}
    for i, xy in enumerate(every):
        chord, sweep = reaches.longest_chord(xy)[0], reaches.longest_sweep(xy)[0]
        assert abs(got[i]["c"] - chord) < 1e-9 and abs(got[i]["r"] - max(chord, sweep)) < 1e-9
    assert got[-1]["r"] is None and got[-2]["c"] is None


def test_reaches_are_found_by_the_batch(monkeypatch):
    box = np.array([(0, 0), (9, 0), (9, 5), (0, 5)], float)
    calls = []
    real = shapes.longest_pieces
    monkeypatch.setattr(shapes, "longest_pieces", lambda *a: calls.append(1) or real(*a))
    sizes = np.full(500, 4)
    lengths, _ = reaches._sweeps(np.tile(box, (500, 1)), sizes)
    assert len(calls) == 2 and np.ptp(lengths) == 0 and lengths[0] == reaches.longest_sweep(box)[0]


def test_shores_of_all_rows_at_once(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [(float(x), float(y)) for x, y in r], float(rng.uniform(600, 1400)), float(rng.uniform(100, 900))) for i, r in enumerate(rings())] + [(-1, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "i int, ring array<struct<x: double, y: double>>, x double, y double")
    r, x, y = F.col("ring"), F.col("x"), F.col("y")
    near = reaches.nearest_on(r, x, y)
    got = df.select(reaches._shore(r, x, y).alias("s"), shapes.contains(r, x, y).alias("c"), near.alias("n")).collect()
    for row in got:
        assert row["s"]["inside"] == row["c"]
        assert (row["s"]["d"], row["s"]["x"], row["s"]["y"]) == ((None,) * 3 if row["n"] is None else (row["n"]["d"], row["n"]["x"], row["n"]["y"]))


def test_frames_are_computed_before_the_points(spark):
    plan = waters._sectors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan.split("Generate")[0]  # what depends on the ring alone comes before its points are made
    assert waters.boxes(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_straight_runs_look_no_further_than_they_must():
    turn = np.linspace(0, 2 * np.pi, 4000, endpoint=False)
    ring = np.column_stack([20_000 * np.cos(turn), 20_000 * np.sin(turn)])
    assert not borders.straight(ring, offset=1.0).any()
    seen = []

    class Watched(list):
        def __getitem__(self, i):
            seen.append(i)
            return list.__getitem__(self, i)

    assert borders._run(Watched([*ring.tolist(), ring[0].tolist()]), 0, 64, 1.0) == 0 and max(seen) <= 64
    flags = borders.straight_edges().func(pa.array([None, [{"x": 0.0, "y": 0.0}, {"x": 3000.0, "y": 0.0}, {"x": 0.0, "y": 1.0}]]))
    assert flags.to_pylist() == [None, [True, True, True]] or flags.to_pylist()[0] is None


def test_places_ask_once(spark, monkeypatch):
    left = [(i, 44 + i % 5 / 10, -86 - i % 3 / 10) for i in range(60)] + [(99, None, 1.0)]
    right = [(i, 44 + i % 7 / 10, -86 - i % 2 / 10) for i in range(200)]
    asked = []
    real = places.near_pairs
    monkeypatch.setattr(places, "near_pairs", lambda a, b, nm: asked.append((a.count(), b.count())) or real(a, b, nm))
    schema = "id long, lat double, lon double"
    got = places.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 3, 400.0).collect()
    assert asked[0] == (15, 42)  # 15 places of 60 rows; three of the rows at each of 14 places
    nm = spark.createDataFrame([(a[0], b[0], *a[1:], *b[1:]) for a in left[:60] for b in right], "i long, j long, a double, b double, c double, d double")
    plain = {}
    for r in nm.select("i", "j", places.geo.distance_nm(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("nm")).collect():
        plain.setdefault(r["i"], []).append((r["nm"], r["j"]))
    assert {(r["id"], r["rank"], r["other"]) for r in got} == {(i, n + 1, x[1]) for i, v in plain.items() for n, x in enumerate(sorted(v)[:3])}


def test_a_crowd_is_searched_from_near(spark):
    crowd = spark.range(20_000).selectExpr("id", "44 + id % 141 / 100 AS lat", "-86 + id % 139 / 100 AS lon")
    assert places._first_reach(crowd, 3, 40.0) < 10 and places._first_reach(crowd.limit(20), 3, 40.0) == 40


def test_equal_rings_and_points_take_part_once(spark, monkeypatch):
    corner = lambda x, y: (float(x), float(y))
    ring = lambda k: [corner(10 * (k % 3), 0), corner(10 * (k % 3) + 15, 0), corner(10 * (k % 3) + 15, 9), corner(10 * (k % 3), 9)]
    schema = "pid long, ring array<struct<x: double, y: double>>"
    polygons = spark.createDataFrame([(k, ring(k)) for k in range(30)], schema)
    points = spark.createDataFrame([(i, float(i % 4) * 9 + 1, 4.0) for i in range(40)], "id long, x double, y double")
    got = {r["id"]: r["pid"] for r in shapes.containing(points, polygons, 8.0).collect()}
    assert got == {i: min(k for k in range(30) if 10 * (k % 3) < i % 4 * 9 + 1 < 10 * (k % 3) + 15) for i in range(40)}
    left = polygons.withColumnRenamed("pid", "id")
    seen = spark.sparkContext.accumulator(0)
    real = reaches.overlap_area

    def counted(a, b):
        seen.add(1)
        return real(a, b)

    monkeypatch.setattr(reaches, "overlap_area", counted)
    area = F.pandas_udf(lambda a, b: reaches.pd.Series([counted(shapes._ring(p), shapes._ring(q)) for p, q in zip(a, b, strict=True)]), "double")
    monkeypatch.setattr(reaches, "_overlap", area)
    found = {(r["id"], r["pid"]): r["area"] for r in reaches.overlaps(left, polygons, 8.0).collect()}
    assert seen.value < 30 and found == {(i, k): 9.0 * (15 - 10 * abs(i % 3 - k % 3)) for i in range(30) for k in range(30) if abs(i % 3 - k % 3) < 2}
    cast = []
    monkeypatch.setattr(reaches.shapes, "once", lambda *a: cast.append(a[1:]) or polygons.where("pid < 3").withColumn("artificial", F.lit(None).cast("array<boolean>")))
    fetch = {r["id"]: r["fetch"] for r in reaches.mask_fetches(points, polygons.withColumn("artificial", F.lit(None).cast("array<boolean>")), "id", bins=4, arc=False).collect()}
    assert cast and len(fetch) == 40 and all(fetch[i] == fetch[i % 4] for i in range(40))


def test_sets_of_keys_are_compared_once(spark):
    rows = lambda name, n, m: spark.createDataFrame([(i, [i % m, i % m + 7, i % m, None]) for i in range(n)] + [(n, None)], f"{name} long, keys array<int>")
    got = {tuple(r) for r in matching.sharing(rows("rid", 50, 5), rows("pid", 40, 9), "keys").collect()}
    sets = lambda i, m: {i % m, i % m + 7}
    assert got == {(i, j, n) for i in range(50) for j in range(40) if (n := len(sets(i, 5) & sets(j, 9)))}
    plan = matching.sharing(rows("rid", 50, 5), rows("pid", 40, 9), "keys")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("count(1)")  # the count comes before the rows are spread


def test_posted_edges_are_not_sent_to_the_driver(spark):
    box = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]
    tiles = spark.createDataFrame([(1, box), (2, [(x + 9, y) for x, y in box])], "pid int, ring array<struct<x: double, y: double>>")
    plan = borders.shared_edges(borders.edge_rows(tiles), 50.0)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_names_are_searched_after_their_grouping(spark):
    plan = checks.tiered_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lower" in plan and "lower" not in plan[plan.rindex("Aggregate [") :]


def test_overlays_of_one_arrangement(spark, monkeypatch):
    ring = lambda x, w: [[{"x": a, "y": b} for a, b in ((x, x), (x + w, x), (x + w, x + w), (x, x + w))]]
    calls = []
    real = overlay._cut
    monkeypatch.setattr(overlay, "_cut", lambda e: calls.append(1) or real(e))
    got = overlay.measured().func(pa.array([[ring(2.0, 3.0)], None], overlay.ARROW), pa.array([[ring(0.0, 10.0)], [ring(4.0, 2.0)]], overlay.ARROW)).to_pylist()
    assert got[0] == {"union": 100.0, "intersection": 9.0, "difference": 0.0, "symmetric_difference": 91.0, "rest": 91.0, "holes": 1} and len(calls) == 2
    assert got[1]["rest"] == got[1]["union"] == 4.0 and got[1]["holes"] == 0
    plan = areas.polygon_overlay(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("holes") and plan.count("run(") <= 8


def test_single_candidates_without_sets(spark):
    c = spark.createDataFrame([(1, 4), (1, 4), (2, 4), (2, 6), (3, 5), (4, 8), (5, None), (5, 2)], "rid int, pid int")
    found = matching.only_candidates(c, c.where("rid = 4"), F.col("pid") % 2 == 0)
    assert sorted(map(tuple, found.collect())) == [(1, 4), (1, 4), (5, 2)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and "distinct" not in plan


def test_links_between_classes_give_all_pairs(spark):
    rows = lambda key, m: spark.createDataFrame([(i, ["round lake", "lake round", "north round lake", "elk pond"][i % m], "ab"[i % 2]) for i in range(40)] + [(99, "round lake", None)], f"{key} long, norm string, area string")
    records, places_ = rows("rid", 4), rows("pid", 3)
    got = linkage.alike_classes(records, places_, "area").collect()
    of = {part: {r["id"]: r["other"] for r in got if r["part"] == part} for part in ("record", "place")}
    links = {(r["id"], r["other"]): r["score"] for r in got if r["part"] == "link"}
    pairs = {(r, p): links[a, b] for r, a in of["record"].items() for p, b in of["place"].items() if (a, b) in links}
    assert pairs == {(r["rid"], r["pid"]): r["score"] for r in linkage.alike(records, places_, "area").collect()} and len(links) < 20 < len(pairs)


def test_entries_are_dealt_over_all_cores(spark):
    assert pages._framed(spark, "/root/testdata/sf0.001", pages.BODIES).rdd.getNumPartitions() >= 4
