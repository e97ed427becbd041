"""Geometry against closed forms and plain loops: chords, sweeps, overlaps, sectors, claims and rays over several waters."""

import math

import numpy as np
import pytest
from pyspark.sql import Row

from tidemark.operators import reaches

ELL = np.array([(0, 0), (10, 0), (10, 2), (2, 2), (2, 10), (0, 10)], float)
SQUARE = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)


def ring(points):
    return [Row(x=float(x), y=float(y)) for x, y in points]


def test_covered_knows_edges_corners_and_crossings():
    at = lambda *p: np.array(p, float)
    assert reaches.covered(ELL, at(0, 0), at(10, 0)) and reaches.covered(ELL, at(10, 2), at(0, 2)) and reaches.covered(ELL, at(0, 4), at(4, 0))
    assert not reaches.covered(ELL, at(10, 2), at(2, 10)) and not reaches.covered(ELL, at(1, 1), at(3, 3)) and not reaches.covered(ELL, at(-1, 1), at(1, 1))


def test_longest_chord():
    assert reaches.longest_chord(ELL)[0] == pytest.approx(math.hypot(10, 2))
    star = np.array([(0, 0), (5, 1), (10, 0), (9, 5), (10, 10), (5, 9), (0, 10), (1, 5)], float)
    pairs = [math.dist(a, b) for i, a in enumerate(star) for b in star[i + 1 :] if reaches.covered(star, a, b)]
    assert reaches.longest_chord(star)[0] == pytest.approx(max(pairs))


def test_longest_chord_takes_pieces_where_no_pair_is_inside():
    # Among so few candidates (the longest pair alone) none lies inside.
    length, a, b = reaches.longest_chord(ELL, candidates=1)
    assert 0 < length <= math.dist((10, 2), (2, 10)) and reaches.covered(ELL, a + (b - a) * 1e-6, b - (b - a) * 1e-6)


def test_reduced_rings_keep_their_corners():
    fine = np.vstack([np.linspace(a, b, 100, endpoint=False) for a, b in zip(ELL, np.roll(ELL, -1, 0), strict=True)])
    out = reaches.reduced(fine, 200)
    assert len(out) <= 200 and all(np.isclose(out, c).all(1).any() for c in ELL)
    assert reaches.longest_chord(fine)[0] == pytest.approx(math.hypot(10, 2))


def test_sweep_finds_reaches_that_end_between_corners():
    length, a, b = reaches.longest_sweep(ELL * 100, 5.0)
    # From the lower right corner past the inner one to the left side, at (0, 250).
    assert 1020 < length <= math.hypot(1000, 250) + 1e-6 and length == pytest.approx(math.dist(a, b))
    assert reaches.covered(ELL * 100, a + (b - a) * 1e-4, b - (b - a) * 1e-4)


def test_overlap_area():
    assert reaches.overlap_area(SQUARE, SQUARE + 1) == pytest.approx(9) and reaches.overlap_area(SQUARE, SQUARE + 4) == 0
    assert reaches.overlap_area(ELL, SQUARE) == pytest.approx(12) and reaches.overlap_area(ELL, ELL) == pytest.approx(36)
    triangle = np.array([(0, 0), (4, 0), (0, 4)], float)
    assert reaches.overlap_area(triangle, SQUARE + 1) == pytest.approx(2) and reaches.overlap_area(SQUARE[::-1], triangle) == pytest.approx(8)


def test_null_and_short_rings_have_no_reach(spark):
    df = spark.createDataFrame([(1, None), (2, ring([(0, 0), (1, 1)])), (3, ring(SQUARE))], "id int, ring array<struct<x: double, y: double>>")
    got = {r.id: r.length for r in df.select("id", reaches.reaches(sweep=False)("ring")["length"].alias("length")).collect()}
    assert got[1] is None and got[2] is None and got[3] == pytest.approx(math.hypot(4, 4))


def test_sectors_of_few_points_are_folded(spark):
    rows = [(1, s) for s, n in {0: 5, 1: 1, 2: 4, 5: 2}.items() for _ in range(n)] + [(2, 3)] + [(3, 1), (3, 2), (3, 2)]
    out = reaches.merge_sectors(spark.createDataFrame(rows, "k int, s int"), "k", "s").groupBy("k", "s").count().collect()
    # Key 1: sector 1 goes to the middle (5 points) rather than to 2 (4), as does 5; a key whose sectors are all too small ends in the middle.
    assert {(r.k, r.s): r["count"] for r in out} == {(1, 0): 8, (1, 2): 4, (2, 0): 1, (3, 2): 3}


def test_names_claim_what_they_see(spark):
    rings = spark.createDataFrame([(1, ring(ELL * 1000))], "lake int, ring array<struct<x: double, y: double>>")
    names = spark.createDataFrame([(1, 1, "North Arm", 1000.0, 9000.0, 2000.0, False), (1, 2, "Cut", 9000.0, 1000.0, 2000.0, True)], "lake int, nid int, name string, x double, y double, run double, channel boolean")
    pts = [(1, 1, 1000.0, 8000.0, 2000.0), (1, 2, 1000.0, 6000.0, 2000.0), (1, 3, 8500.0, 1000.0, 2000.0), (1, 4, 7500.0, 1000.0, 2000.0), (1, 5, 1000.0, 8000.0, 9000.0)]
    got = reaches.claimed(spark.createDataFrame(pts, "lake int, pt int, x double, y double, width double"), names, rings, "lake").collect()
    assert {r.pt: r.name for r in got} == {1: "North Arm", 3: "Cut"}


def plain_fetch(rings, x, y, bearing, cap, step=0.25):
    """Walks the ray in small steps until no ring holds it for more than a metre."""
    dx, dy, dry_since, t = math.sin(math.radians(bearing)), math.cos(math.radians(bearing)), None, 0.0
    inside = lambda px, py: any(a <= px <= c and b <= py <= d for a, b, c, d in rings)
    while t < cap:
        if inside(x + dx * t, y + dy * t):
            dry_since = None
        else:
            dry_since = t if dry_since is None else dry_since
            if t - dry_since > 1.0:
                return dry_since
        t += step
    return cap if dry_since is None else min(dry_since, cap)


def test_rays_cross_borders_between_waters(spark):
    boxes = [(0, 0, 100, 100), (100, 0, 250, 60), (250.5, 0, 300, 60), (90, 50, 120, 400)]  # a border, a gap below a metre, an overlap
    rows = [(i, ring([(a, b), (c, b), (c, d), (a, d)]), None) for i, (a, b, c, d) in enumerate(boxes)]
    waters = spark.createDataFrame(rows, "pid int, ring array<struct<x: double, y: double>>, artificial array<boolean>")
    pts = [(i, float(7 + i * 13 % 85), 5.3 + i * 29 % 90) for i in range(30)]  # never along an edge
    pts += [(99, 5000.0, 5000.0)]
    df = spark.createDataFrame(pts, "pt int, x double, y double")
    got = {r.pt: r.fetch for r in reaches.mask_fetches(df, waters, "pt", bins=8, arc=False, cap=280.0, cell=200.0, most=7).collect()}
    assert len(got) == 31 and set(got[99]) == {280.0}  # no water near: nothing to leave
    for i, x, y in pts[:30]:
        assert got[i] == pytest.approx([plain_fetch(boxes, x, y, b * 45.0, 280.0) for b in range(8)], abs=0.6)


def test_artificial_edges_count_as_open(spark):
    waters = spark.createDataFrame([(1, ring(SQUARE * 10), [False, True, False, False])], "pid int, ring array<struct<x: double, y: double>>, artificial array<boolean>")
    got = reaches.mask_fetches(spark.createDataFrame([(1, 10.0, 10.0)], "pt int, x double, y double"), waters, "pt", bins=4, arc=False, cap=500.0).first().fetch
    assert got == pytest.approx([30, 500, 10, 10])
