"""Overlays, borders, straight runs and the projection against closed forms, plain versions and published coordinates."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import projection
from tidemark.operators import borders, overlay

POINTS = "array<struct<x: double, y: double>>"


def box(a, b, c, d):
    return np.array([(a, b), (c, b), (c, d), (a, d)], float)


def area(shape):
    one = lambda r: abs(float((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum())) / 2
    return sum(one(r) * (1 if i == 0 else -1) for rings in shape for i, r in enumerate(rings))


def over(kind, a, b):
    return overlay.combined([[a], [b]], overlay.KINDS[kind])


def star(r, cx, cy, size):
    n = r.integers(8, 40)
    turn = (np.arange(n) + r.uniform(0, 0.9, n)) * 2 * np.pi / n
    far = size * r.uniform(0.4, 1, n)
    return np.stack([cx + far * np.cos(turn), cy + far * np.sin(turn)], 1)


def test_overlays_of_boxes():
    a = [[box(0, 0, 10, 10)]]
    cases = {"cross": box(5, 5, 15, 15), "touch": box(10, 0, 20, 10), "inside": box(2, 2, 8, 8), "corner": box(10, 10, 12, 12), "same": box(0, 0, 10, 10), "apart": box(20, 20, 21, 21)}
    want = {"cross": (175, 25, 75, 150), "touch": (200, 0, 100, 200), "inside": (100, 36, 64, 64), "corner": (104, 0, 100, 104), "same": (100, 100, 0, 0), "apart": (101, 0, 100, 101)}
    for name, ring in cases.items():
        for b in ([[ring]], [[ring[::-1]]]):  # either direction
            assert [area(over(k, a, b)) for k in overlay.KINDS] == pytest.approx(want[name])
    assert [len(p) for p in over("difference", a, [[cases["inside"]]])] == [2] and [len(r) for p in over("union", a, [[cases["touch"]]]) for r in p] == [4]
    assert over("union", [], []) == [] and area(over("difference", a, [])) == pytest.approx(100)


def test_overlays_with_holes():
    ring = [[box(0, 0, 30, 30), box(10, 10, 20, 20)]]
    assert area(over("intersection", ring, [[box(5, 5, 25, 25)]])) == pytest.approx(300)
    filled = over("union", ring, [[box(10, 10, 20, 20)]])
    assert area(filled) == pytest.approx(900) and [len(p) for p in filled] == [1]
    island = over("union", ring, [[box(13, 13, 17, 17)]])  # an island in the hole: two polygons, one hole
    assert area(island) == pytest.approx(816) and sorted(len(p) for p in island) == [1, 2]
    bridge = over("difference", [[box(0, 0, 30, 30)]], [[box(10, -5, 12, 35)], [box(20, 10, 22, 12)]])
    assert area(bridge) == pytest.approx(900 - 60 - 4) and sorted(len(p) for p in bridge) == [1, 2]


def test_overlay_areas_add_up():
    r = np.random.default_rng(3)
    for _ in range(60):
        a, b = [[star(r, 0, 0, 10)]], [[star(r, *r.uniform(-8, 8, 2), 8)]]
        u, n, d, s = (area(over(k, a, b)) for k in overlay.KINDS)
        assert (u + n, d + n, s) == pytest.approx((area(a) + area(b), area(a), u - n), abs=1e-3)


def test_unions_against_counted_points():
    r = np.random.default_rng(5)
    several = [[[star(r, *r.uniform(0, 60, 2), 9)]] for _ in range(40)]
    out = overlay.combined([several], lambda n: n > 0)
    at = r.uniform(-5, 65, (4000, 2))
    inside = lambda shape, p: any(sum(overlay._inside(ring, p) for ring in rings) % 2 for rings in shape)
    assert all(inside(out, p) == any(inside(s, p) for s in several) for p in at)


def test_dissolved_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(overlay, "FAN", 3)
    ring = lambda x, w: [Row(x=float(a), y=float(b)) for a, b in box(x, 0, x + w, 10)]
    rows = [("a", ring(i * 5, 6)) for i in range(20)] + [("b", ring(0, 1)), ("b", ring(3, 1)), ("b", None), ("c", None)]
    df = spark.createDataFrame(rows, f"k string, ring {POINTS}").withColumn("shape", overlay.polygon(F.col("ring")))
    got = {r.k: (r.n, round(r.a, 6)) for r in overlay.dissolved(df, "k", "shape").select("k", F.size("shape").alias("n"), overlay.area(F.col("shape")).alias("a")).collect()}
    assert got == {"a": (1, 1010.0), "b": (2, 20.0), "c": (0, 0.0)}
    assert overlay.dissolved(df.where("k = 'x'"), "k", "shape").count() == 0


def test_shapes_as_columns(spark):
    ring = lambda *b: [Row(x=float(a), y=float(c)) for a, c in box(*b)]
    df = spark.createDataFrame([(ring(0, 0, 10, 10), [ring(4, 4, 6, 6)], ring(20, 0, 21, 1))], f"ring {POINTS}, holes array<{POINTS}>, small {POINTS}")
    shape = F.concat(overlay.polygon(F.col("ring"), F.col("holes")), overlay.polygon(F.col("small")))
    row = df.select(overlay.area(shape).alias("area"), overlay.area(overlay.parts(shape, 2.0)).alias("large"), *[overlay.contains(shape, F.lit(x), F.lit(y)).alias(n) for n, x, y in (("in", 2.0, 2.0), ("hole", 5.0, 5.0), ("small", 20.5, 0.5), ("out", 15.0, 1.0))]).first()
    assert (row["area"], row["large"], row["in"], row["hole"], row["small"], row["out"]) == (97.0, 96.0, True, False, True, False)


def test_shared_edges_of_any_direction(spark):
    r = np.random.default_rng(8)
    polygons, want = [], {}
    for k in range(40):  # pairs of boxes, turned, that share a part of a side (or none)
        turn, (cx, cy), w, shift = r.uniform(0, 2 * np.pi), r.uniform(0, 1e6, 2), r.uniform(20, 3000), r.uniform(-30, 30)
        rot = np.array([[np.cos(turn), np.sin(turn)], [-np.sin(turn), np.cos(turn)]])
        gap = 0.0 if k % 4 else 5.0
        one, two = (b @ rot + (cx, cy) for b in (box(0, 0, w, 50), box(shift, 50 + gap, shift + w, 90)))
        polygons += [(2 * k, one), (2 * k + 1, two)]
        want[2 * k] = want[2 * k + 1] = 0.0 if gap else max(w - abs(shift), 0.0)
    df = spark.createDataFrame([(k, [Row(x=float(x), y=float(y)) for x, y in p]) for k, p in polygons], f"pid long, ring {POINTS}")
    edges = borders.edge_rows(df)
    got = {r.pid: r.m for r in borders.internal_edges(edges, 400.0).groupBy("pid").agg(F.sum("shared_m").alias("m")).collect()}
    assert got == pytest.approx(want, abs=0.05)


def plain_straight(xy, offset, least, stride):
    """A run is tried from the side that holds each place; it goes on corner by corner while all corners between are near the chord."""
    p = np.vstack([xy, xy[:1]])
    gone = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])

    def off(i, j):
        d = p[j] - p[i]
        return max((abs((p[k] - p[i])[0] * d[1] - (p[k] - p[i])[1] * d[0]) / math.hypot(*d) for k in range(i + 1, j)), default=0.0)

    out, reached, at = np.zeros(len(xy), bool), 0, 0.0
    while at <= gone[-1] - least + 1e-9:
        i = max(k for k in range(len(p)) if gone[k] <= at)
        at += stride
        if i < reached or i >= len(xy):
            continue
        j = next((k for k in range(i, len(p)) if gone[k] >= gone[i] + least), None)
        if j is None or off(i, j) > offset:
            continue
        while j < len(xy) and off(i, j + 1) <= offset:
            j += 1
        out[i:j] = True
        reached = j
    return out


def test_straight_runs_against_every_chord():
    r = np.random.default_rng(2)
    for _ in range(30):
        n = int(r.integers(20, 120))
        turn = np.sort(r.uniform(0, 2 * np.pi, n))
        shore = np.stack([3000 * np.cos(turn), 2000 * np.sin(turn)], 1) + r.normal(0, r.choice([1.0, 30.0]), (n, 2))
        line = np.stack([np.linspace(3000, 6000, 40), np.full(40, -2500.0)], 1) + r.normal(0, r.choice([0.5, 4.0, 9.0]), (40, 2))
        xy = np.vstack([line, shore])
        assert (borders.straight(xy, 10.0, 800.0, 100.0) == plain_straight(xy, 10.0, 800.0, 100.0)).all()
    assert not borders.straight(np.zeros((0, 2))).any() and not borders.straight(box(0, 0, 10, 10)).any()


def test_straight_runs_of_null_rings(spark):
    df = spark.createDataFrame([(None,), ([],)], f"ring {POINTS}")
    assert [r.f for r in df.select(borders.straight_edges()("ring").alias("f")).collect()] == [None, []]


def test_projection(spark):
    # A worked example of the oblique Mercator in a public guide to coordinate conversions.
    grid = projection.Oblique(6377298.556, 300.8017, 4.0, 115.0, 53.31582047, 53.13010236, 0.99984, 0.0, 0.0)
    p = spark.createDataFrame([(5.3872535833, 115.8055054444)], "lat double, lon double")
    row = p.select(projection.to_grid(F.col("lat"), F.col("lon"), grid).alias("g")).first().g
    assert (row.x, row.y) == pytest.approx((679245.73, 596562.78), abs=0.05)
    places = spark.createDataFrame([(41.0 + i * 0.1, -91.0 + j * 0.25) for i in range(70) for j in range(40)], "lat double, lon double")
    g = places.withColumn("g", projection.to_grid(F.col("lat"), F.col("lon")))
    back = g.withColumn("b", projection.from_grid(F.col("g.x"), F.col("g.y"))).select(F.max(F.greatest(F.abs(F.col("b.lat") - F.col("lat")), F.abs(F.col("b.lon") - F.col("lon"))))).first()[0]
    assert back < 1e-8  # about a millimetre
    # At the centre grid north is true north; the centre lies about where the grid was laid out to have it.
    c = spark.createDataFrame([(45.30916666666666, -86.0)], "lat double, lon double").select(projection.to_grid(F.col("lat"), F.col("lon")).alias("g"), projection.convergence(F.col("lat"), F.col("lon")).alias("c")).first()
    assert abs(c.c) < 1e-4 and (c.g.x, c.g.y) == pytest.approx((499839.83, 528600.24), abs=1.0)
