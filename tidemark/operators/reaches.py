"""Straight reaches inside polygons, shores, overlaps of polygons, sectors and named parts of a water, and rays over a mask of many waters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import rays, shapes

#: Degrees of the coarse and the fine sweep and how many best ones are refined, least spacing of scan lines and their part of a mean width.
SWEEP_STEP, REFINE_TOP, REFINE_REACH, REFINE_STEP = 3.0, 3, 1.5, 0.25
LEAST_SPACING_M, SPACING_PART = 8.0, 0.5
#: Offsets of the five rays of a bin, longest fetch, shore that a craft keeps off.
ARC, FETCH_CAP_M, SHORE_M = [-12.0, -6.0, 0.0, 6.0, 12.0], 100_000.0, 30.48
#: How far out the middle of a water reaches, points that a sector needs, and how far and wide a name may claim.
MIDDLE, SECTOR_POINTS = 0.45, 3
NAME_PART, NAME_LEAST_M, NAME_MOST_M, CHANNEL_MOST_M, WIDTH_FACTOR = 1.25, 250.0, 6000.0, 1000.0, 2.5
#: Classes of airspace, the most restrictive first.
AIRSPACE = ["B", "C", "D", "E", "G"]

SHORE = T.StructType([T.StructField("inside", T.BooleanType()), *[T.StructField(c, T.DoubleType()) for c in "dxy"]])
REACH = "struct<length: double, x1: double, y1: double, x2: double, y2: double>"


def _cuts(xy: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where (0 to 1) the segment a-b may change sides of a ring, with both ends, and whether each stretch between lies inside or on the ring."""
    d, p = b - a, xy
    e = np.roll(p, -1, 0) - p
    size = max(float(np.hypot(*d)), 1e-12)
    eps = 1e-9 * max(size, 1.0)
    denom = d[0] * e[:, 1] - d[1] * e[:, 0]
    sloped = np.abs(denom) > 1e-12 * size
    safe = np.where(sloped, denom, 1.0)
    t = ((p[:, 0] - a[0]) * e[:, 1] - (p[:, 1] - a[1]) * e[:, 0]) / safe
    u = ((p[:, 0] - a[0]) * d[1] - (p[:, 1] - a[1]) * d[0]) / safe
    crossing = t[sloped & (u >= -1e-9) & (u <= 1 + 1e-9)]
    off = np.abs((p[:, 0] - a[0]) * d[1] - (p[:, 1] - a[1]) * d[0]) / size
    on = (((p - a) @ d) / size**2)[off <= eps]  # corners on the segment, as of edges along it
    ts = np.unique(np.clip(np.concatenate([[0.0, 1.0], crossing, on]), 0, 1))
    ts = ts[np.concatenate([[True], np.diff(ts) * size > eps])]
    ts[-1] = 1.0
    mid = a + ((ts[:-1] + ts[1:]) / 2)[:, None] * d
    q = np.roll(p, -1, 0)
    spans = (p[:, 1] > mid[:, 1:]) != (q[:, 1] > mid[:, 1:])
    rise = np.where(e[:, 1] == 0, 1.0, e[:, 1])
    inside = (spans & (mid[:, :1] < p[:, 0] + (mid[:, 1:] - p[:, 1]) / rise * e[:, 0])).sum(1) % 2 == 1
    span2 = np.maximum((e**2).sum(1), 1e-300)
    k = np.clip(((mid[:, None, :] - p) * e).sum(2) / span2, 0, 1)
    near = np.hypot(*np.moveaxis(mid[:, None, :] - (p + k[:, :, None] * e), 2, 0)).min(1) <= eps
    return ts, inside | near


def covered(xy: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the segment a-b lies inside a ring; the ring itself belongs to it."""
    return bool(_cuts(xy, a, b)[1].all())


def _simplified(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """The corners of a closed line that are further than the tolerance from the line without them."""
    keep, open_spans = np.zeros(len(xy), bool), [(0, len(xy) - 1)]
    keep[[0, -1]] = True
    while open_spans:
        i, j = open_spans.pop()
        if j - i < 2:
            continue
        a, d = xy[i], xy[j] - xy[i]
        k = np.clip(((xy[i + 1 : j] - a) @ d) / max(float(d @ d), 1e-300), 0, 1)
        gap = np.hypot(*(xy[i + 1 : j] - a - k[:, None] * d).T)
        if gap.max() > tolerance:
            m = i + 1 + int(gap.argmax())
            keep[m] = True
            open_spans += [(i, m), (m, j)]
    return xy[keep]


def reduced(xy: np.ndarray, most: int) -> np.ndarray:
    """A ring with at most `most` corners: simplified with a tolerance that doubles up to twelve times, else every n-th corner."""
    closed = np.vstack([xy, xy[:1]])
    if len(closed) <= most:
        return xy
    tolerance = max(float(np.hypot(*np.diff(closed, axis=0).T).sum()) / (most * 8.0), 1e-6)
    for _ in range(12):
        out = _simplified(closed, tolerance)
        if len(out) <= most:
            return out[:-1]
        tolerance *= 2
    return closed[:: -(-len(closed) // most)]


def longest_chord(xy: np.ndarray, corners: int = 200, candidates: int = 1000) -> tuple[float, np.ndarray, np.ndarray]:
    """The longest of the `candidates` longest pairs of corners whose segment is inside; where none is, the longest inner piece of the 32 longest."""
    pts = reduced(xy, corners)
    i, j = np.triu_indices(len(pts), k=1)
    d = np.hypot(*(pts[i] - pts[j]).T)
    order = np.argsort(-d, kind="stable")[:candidates]
    for k in order:
        if covered(xy, pts[i[k]], pts[j[k]]):
            return float(d[k]), pts[i[k]], pts[j[k]]
    best = (0.0, xy[0], xy[0])
    for n, k in enumerate(order[:32]):
        a, b = pts[i[k]], pts[j[k]]
        ts, wet = _cuts(xy, a, b)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], wet.astype(int), [0]])))
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            if (ts[e] - ts[s]) * d[k] > best[0]:
                best = (float((ts[e] - ts[s]) * d[k]), a + ts[s] * (b - a), a + ts[e] * (b - a))
        if best[0] >= d[order[min(n + 1, len(order) - 1)]]:
            break  # no later pair is as long
    return best


def spacing_of(xy: np.ndarray) -> float:
    """Distance of scan lines: half the mean width, 8 m at least."""
    q = np.roll(xy, -1, 0)
    around = float(np.hypot(*(q - xy).T).sum())
    area = abs(float((xy[:, 0] * q[:, 1] - q[:, 0] * xy[:, 1]).sum())) / 2
    return max(2 * area / around * SPACING_PART if around else 0.0, LEAST_SPACING_M)


def longest_sweep(xy: np.ndarray, spacing: float | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """The longest stretch over bearings 3 degrees apart, refined around the three best; its ends need not be corners."""
    step = spacing or spacing_of(xy)
    coarse = [(shapes.longest_piece(xy, b, step), b) for b in np.arange(0.0, 180.0, SWEEP_STEP)]
    best = max((c[0] for c in coarse), key=lambda r: r[0])
    for _, b in sorted(coarse, key=lambda c: -c[0][0])[:REFINE_TOP]:
        for fine in np.arange(b - REFINE_REACH, b + REFINE_REACH + 1e-9, REFINE_STEP):
            found = shapes.longest_piece(xy, float(fine), step)
            best = found if found[0] > best[0] else best
    length, a, b = best
    inset = (b - a) / max(length, 1e-12) * 0.01
    if length <= 0 or (length > 0.02 and not covered(xy, a + inset, b - inset)):
        return 0.0, xy[0] * 0, xy[0] * 0
    return best


def _chords(xy: np.ndarray, sizes: np.ndarray, corners: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """`longest_chord` of many rings: lengths and ends (rings, 2, 2). In a convex one any two corners see each other, so the longest pair is the answer; rings of a size go together."""
    starts, lengths, ends = np.cumsum(sizes) - sizes, np.full(len(sizes), np.nan), np.full((len(sizes), 2, 2), np.nan)
    plain = shapes.convex(xy, sizes) & (sizes < corners)
    for n in np.unique(sizes[plain]):
        i, j = np.triu_indices(n, k=1)
        of = np.flatnonzero(plain & (sizes == n))
        for some in np.array_split(of, len(of) * len(i) // shapes.CORNERS + 1):
            p = xy[starts[some][:, None] + np.arange(n)]
            d = np.hypot(*np.moveaxis(p[:, i] - p[:, j], 2, 0))
            k, row = d.argmax(1), np.arange(len(some))
            lengths[some], ends[some, 0], ends[some, 1] = d[row, k], p[row, i[k]], p[row, j[k]]
    for r in np.flatnonzero(~plain & (sizes > 2)):
        lengths[r], ends[r, 0], ends[r, 1] = longest_chord(xy[starts[r] : starts[r] + sizes[r]])
    return lengths, ends


def _sweeps(xy: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`longest_sweep` of many rings of three corners or more: lengths and ends, all bearings of all rings at once."""
    starts, n = np.cumsum(sizes) - sizes, len(sizes)
    spacing, rows = np.array([spacing_of(xy[s : s + k]) for s, k in zip(starts, sizes, strict=True)]), np.arange(n)
    tried = lambda of, bearings: shapes.longest_pieces(xy, sizes, np.repeat(of, bearings.shape[1]), bearings.ravel(), np.repeat(spacing[of], bearings.shape[1]))
    bearings = np.arange(0.0, 180.0, SWEEP_STEP)
    coarse, coarse_ends = tried(rows, np.tile(bearings, (n, 1)))
    coarse = coarse.reshape(n, -1)
    best = coarse.argmax(1)
    top = bearings[np.argsort(-coarse, axis=1, kind="stable")[:, :REFINE_TOP]]
    fine, fine_ends = tried(rows, (top[:, :, None] - REFINE_REACH + np.arange(round(2 * REFINE_REACH / REFINE_STEP) + 1) * REFINE_STEP).reshape(n, -1))
    lengths = np.column_stack([coarse[rows, best], fine.reshape(n, -1)])
    ends = np.concatenate([coarse_ends.reshape(n, -1, 2, 2)[rows, best][:, None], fine_ends.reshape(n, -1, 2, 2)], 1)
    best = lengths.argmax(1)
    lengths, ends = lengths[rows, best], ends[rows, best]
    plain = shapes.convex(xy, sizes)
    for r in np.flatnonzero(~plain & (lengths > 0.02)):
        a, b = ends[r]
        inset = (b - a) / max(lengths[r], 1e-12) * 0.01
        if not covered(xy[starts[r] : starts[r] + sizes[r]], a + inset, b - inset):
            lengths[r] = 0.0
    ends[lengths <= 0] = 0.0
    return lengths, ends


def reaches(sweep: bool = True):
    """A function of a ring column: struct(length, x1, y1, x2, y2), the longest straight reach; with `sweep` the better of chord and sweep, as for rivers."""

    @F.arrow_udf(REACH)
    def run(rings: pa.Array) -> pa.Array:
        xy, sizes = shapes.flat(rings)
        water = sizes > 2
        xy, sizes = xy[np.repeat(water, sizes)], sizes[water]
        best = np.zeros((len(sizes), 5))
        if len(sizes):
            length, ends = _chords(xy, sizes)
            if sweep:
                swept, swept_ends = _sweeps(xy, sizes)
                length, ends = np.where(swept > length, swept, length), np.where((swept > length)[:, None, None], swept_ends, ends)
            best = np.column_stack([length, ends.reshape(-1, 4)])
        out = np.full((len(water), 5), np.nan)
        out[water] = best
        columns = [pa.array(c, mask=~water) for c in out.T]
        return pa.StructArray.from_arrays(columns, ["length", "x1", "y1", "x2", "y2"])

    return run


def runs_through(fetches: Column) -> Column:
    """array<double>: the straight run through a point at each of the first half of the bearings, out of the distances to the shore at all of them."""
    half = (F.size(fetches) / 2).cast("int")
    return F.zip_with(F.slice(fetches, 1, half), F.slice(fetches, half + 1, half), lambda a, b: a + b)


def ray_bearings(bins: int = 16, arc: bool = True, convergence: float = 0.0) -> Column:
    """array<array<double>>: grid bearings of the rays of each bin, five on an arc or one."""
    offsets = ARC if arc else [0.0]
    return F.array(*[F.array(*[F.lit(b * 360.0 / bins + o - convergence) for o in offsets]) for b in range(bins)])


def nearest_on(ring: Column, x: Column, y: Column) -> Column:
    """struct(d, x, y): the place of a ring nearest to a point, and its distance."""

    def near(e: Column) -> Column:
        a, dx, dy = e["a"], e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        span = dx * dx + dy * dy
        t = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.when(span > 0, span)))).otherwise(0.0)
        px, py = a["x"] + t * dx, a["y"] + t * dy
        return F.struct(F.sqrt((px - x) * (px - x) + (py - y) * (py - y)).alias("d"), px.alias("x"), py.alias("y"))

    return F.array_min(F.transform(shapes.edges(ring), near))


@F.arrow_udf(SHORE)
def shore(rings: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
    """Whether a ring holds a point, and the place of it that is nearest to the point, with its distance: `contains` and `nearest_on` for all rows at once."""
    xy, sizes = shapes.flat(rings)
    who, b = np.repeat(np.arange(len(sizes)), sizes), xy[shapes.following(sizes)]
    asked = xs.is_valid().to_numpy(zero_copy_only=False) & ys.is_valid().to_numpy(zero_copy_only=False)
    x, y = (c.to_numpy(zero_copy_only=False).astype(float)[who] for c in (xs, ys))
    e = b - xy
    spans = (xy[:, 1] > y) != (b[:, 1] > y)
    crossed = spans & (x < xy[:, 0] + (y - xy[:, 1]) / np.where(spans, e[:, 1], 1.0) * e[:, 0])
    inside = np.bincount(who[crossed], minlength=len(sizes)) % 2 == 1
    span = e[:, 0] * e[:, 0] + e[:, 1] * e[:, 1]
    t = np.where(span > 0, np.clip(((x - xy[:, 0]) * e[:, 0] + (y - xy[:, 1]) * e[:, 1]) / np.where(span > 0, span, 1.0), 0.0, 1.0), 0.0)
    px, py = xy[:, 0] + t * e[:, 0], xy[:, 1] + t * e[:, 1]
    d = np.sqrt((px - x) * (px - x) + (py - y) * (py - y))
    order = np.lexsort((py, px, d, who))
    first = order[(np.cumsum(sizes) - sizes)[sizes > 0]]
    out = np.zeros((3, len(sizes)))
    out[:, sizes > 0] = d[first], px[first], py[first]
    missing = ~asked | (sizes == 0)
    known = rings.is_valid().to_numpy(zero_copy_only=False)
    return pa.StructArray.from_arrays([pa.array(inside, mask=~known), *[pa.array(c, mask=missing) for c in out]], ["inside", "d", "x", "y"])


def _shore(ring: Column, x: Column, y: Column) -> Column:
    return shore(ring, x.cast("double"), y.cast("double"))


def snapped(ring: Column, x: Column, y: Column) -> Column:
    """struct(x, y): a point inside a ring as it is, another at the nearest place of the ring."""
    near = _shore(ring, x, y)
    return F.when(near["inside"], F.struct(x.alias("x"), y.alias("y"))).otherwise(F.struct(near["x"].alias("x"), near["y"].alias("y")))


def reach_of(ring: Column, x: Column, y: Column, buffer: float) -> Column:
    """struct(inside, near): whether a ring holds a point, and whether it is within `buffer` of it."""
    near = _shore(ring, x, y)
    return F.struct(near["inside"].alias("inside"), (near["inside"] | (near["d"] <= buffer)).alias("near"))


def usable(ring: Column, x: Column, y: Column, shore: float = SHORE_M) -> Column:
    """Whether a point is inside a ring and keeps off its shore: what a negative buffer would hold."""
    near = _shore(ring, x, y)
    return near["inside"] & (near["d"] >= shore)


def overlap_area(xy: np.ndarray, other: np.ndarray) -> float:
    """Area of what two rings have in common: between the heights at which anything begins, ends or crosses, widths change evenly."""
    p = np.vstack([xy, other])
    q = np.vstack([np.roll(xy, -1, 0), np.roll(other, -1, 0)])
    low, high = max(xy[:, 1].min(), other[:, 1].min()), min(xy[:, 1].max(), other[:, 1].max())
    if low >= high or max(xy[:, 0].min(), other[:, 0].min()) >= min(xy[:, 0].max(), other[:, 0].max()):
        return 0.0
    n, heights = len(xy), [p[:, 1]]
    for a, b in zip(p[:n], q[:n], strict=True):
        d, e = b - a, q[n:] - p[n:]
        denom = d[0] * e[:, 1] - d[1] * e[:, 0]
        safe = np.where(denom == 0, 1.0, denom)
        t = ((p[n:, 0] - a[0]) * e[:, 1] - (p[n:, 1] - a[1]) * e[:, 0]) / safe
        u = ((p[n:, 0] - a[0]) * d[1] - (p[n:, 1] - a[1]) * d[0]) / safe
        heights.append((a[1] + t * d[1])[(denom != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)])
    ys = np.unique(np.clip(np.concatenate(heights), low, high))
    total = 0.0
    for y0, y1 in zip(ys[:-1], ys[1:], strict=True):
        y = (y0 + y1) / 2
        cut = (p[:, 1] > y) != (q[:, 1] > y)
        x = p[cut, 0] + (y - p[cut, 1]) / (q[cut, 1] - p[cut, 1]) * (q[cut, 0] - p[cut, 0])
        mine = np.flatnonzero(cut) < n
        a, b = np.sort(x[mine]).reshape(-1, 2), np.sort(x[~mine]).reshape(-1, 2)
        shared = np.minimum(a[:, None, 1], b[None, :, 1]) - np.maximum(a[:, None, 0], b[None, :, 0])
        total += float(np.maximum(shared, 0).sum()) * (y1 - y0)
    return total


@F.pandas_udf(T.DoubleType())
def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([overlap_area(shapes._ring(p), shapes._ring(q)) for p, q in zip(a, b, strict=True)], dtype="float64")


def _posted(polygons: DataFrame, key: str, cell: float) -> DataFrame:
    at = lambda f, axis: F.floor(f(F.transform("ring", lambda p: p[axis])) / cell)
    out = polygons.select(key, F.explode(F.sequence(at(F.array_min, "x"), at(F.array_max, "x"))).alias("gx"), at(F.array_min, "y").alias("_s"), at(F.array_max, "y").alias("_n"))
    return out.select(key, "gx", F.explode(F.sequence("_s", "_n")).alias("gy"))


def overlaps(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """(id, pid, area): the polygons (id, ring) and (pid, ring) that have an area in common. Boxes meet by cells as ids; rings are fetched once a pair, and equal rings are compared once."""
    a, b = shapes.once(left, "id"), shapes.once(right, "pid")
    pairs = _posted(a, "id", cell).join(_posted(b, "pid", cell), ["gx", "gy"]).select("id", "pid").distinct()
    rings = pairs.join(a.select("id", F.col("ring").alias("_a")), "id").join(b.select("pid", F.col("ring").alias("_b")), "pid")
    found = rings.select("_a", "_b", _overlap("_a", "_b").alias("area")).where("area > 0")
    return found.join(left.select("id", F.col("ring").alias("_a")), "_a").join(right.select("pid", F.col("ring").alias("_b")), "_b").select("id", "pid", "area")


def touching(found: DataFrame) -> DataFrame:
    """(id, pids): the ids that each polygon overlaps, in order."""
    return found.groupBy("id").agg(F.array_sort(F.collect_set("pid")).alias("pids"))


def largest_overlap(found: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name): the name of the unit (pid, name) that covers most; unnamed units don't count, of equals the smaller pid."""
    named = found.join(names.where(F.col("name").isNotNull()), "pid")
    return named.groupBy("id").agg(F.max_by("name", F.struct("area", (-F.col("pid")).alias("p"))).alias("name"))


def first_named(hits: DataFrame) -> DataFrame:
    """(id, name): of the hits (id, pid, name) the name with the smallest pid; unnamed ones don't count."""
    return hits.where(F.col("name").isNotNull()).groupBy("id").agg(F.min_by("name", "pid").alias("name"))


def at_surface(value: Column, code: Column | None = None) -> Column:
    """Whether an airspace starts at the surface: its floor is 0, or in tables without floors (`code` given), its code is SFC."""
    by_floor = F.coalesce(value.try_cast("double") == 0, F.lit(False))
    return by_floor if code is None else F.coalesce(F.upper(F.trim(code)) == "SFC", F.lit(False))


def most_restrictive(hits: DataFrame) -> DataFrame:
    """(id, airspace): the most restrictive class of the hits (id, class); blank classes and NONE don't count, unknown ones rank last, by name."""
    c = F.upper(F.trim("class"))
    place = F.array_position(F.array(*map(F.lit, AIRSPACE)), c)
    kept = hits.select("id", c.alias("airspace"), F.when(place > 0, place).otherwise(len(AIRSPACE) + 1).alias("_r")).where("airspace NOT IN ('', 'NONE')")
    return kept.groupBy("id").agg(F.min_by("airspace", F.struct("_r", "airspace")).alias("airspace"))


def sector_frame(ring: Column, convergence: float = 0.0) -> Column:
    """struct(cx, cy, e, n): a ring's centroid and half extents, which its sectors are told by; to be computed once for all points of a ring."""
    cos, sin = float(np.cos(np.radians(convergence))), float(np.sin(np.radians(convergence)))
    first = F.get(ring, F.lit(0))  # sums are taken from a corner, so far coordinates keep their digits

    def add(s: Column, e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"] - first["x"], e["a"]["y"] - first["y"], e["b"]["x"] - first["x"], e["b"]["y"] - first["y"]
        w = ax * by - bx * ay
        return F.struct((s["w"] + w).alias("w"), (s["x"] + (ax + bx) * w).alias("x"), (s["y"] + (ay + by) * w).alias("y"))

    def middle(sums: Column) -> Column:
        cx, cy = first["x"] + sums["x"] / F.nullif(3 * sums["w"], F.lit(0.0)), first["y"] + sums["y"] / F.nullif(3 * sums["w"], F.lit(0.0))
        return F.struct(cx.alias("cx"), cy.alias("cy"))

    def frame(c: Column) -> Column:
        half = lambda axis: F.greatest(F.array_max(F.transform(ring, lambda p: F.abs(axis(p["x"] - c["cx"], p["y"] - c["cy"])))), F.lit(1.0))
        return F.struct(c["cx"].alias("cx"), c["cy"].alias("cy"), half(lambda x, y: x * cos + y * sin).alias("e"), half(lambda x, y: y * cos - x * sin).alias("n"))

    sums = F.aggregate(shapes.edges(ring), F.struct(*[F.lit(0.0).alias(c) for c in "wxy"]), add)
    return shapes.held(shapes.held(sums, middle), frame)


def sector_in(frame: Column, x: Column, y: Column, convergence: float = 0.0) -> Column:
    """The sector of a point, by the frame of its ring."""
    cos, sin = float(np.cos(np.radians(convergence))), float(np.sin(np.radians(convergence)))
    e = ((x - frame["cx"]) * cos + (y - frame["cy"]) * sin) / frame["e"]
    n = ((y - frame["cy"]) * cos - (x - frame["cx"]) * sin) / frame["n"]
    out = F.floor(F.pmod(F.degrees(F.atan2(e, n)), F.lit(360.0)) / 45 + 0.5) % 8 + 1
    return F.when(F.sqrt(e * e + n * n) < MIDDLE, 0).otherwise(out).cast("int")


def sector(ring: Column, x: Column, y: Column, convergence: float = 0.0) -> Column:
    """0 in the middle of a ring, else 1 to 8 clockwise from north, by bearing from its centroid with each axis as a part of its half extent."""
    return shapes.held(sector_frame(ring, convergence), lambda f: sector_in(f, x, y, convergence))


def _merged_sectors(counts: np.ndarray, least: int) -> list[int]:
    counts, now = counts.copy(), np.arange(9)
    for _ in range(16):
        small = [s for s in range(1, 9) if 0 < counts[s] < least]
        if not small:
            break
        s = min(small, key=lambda x: (counts[x], x))
        beside = [o for o in (0, (s - 2) % 8 + 1, s % 8 + 1) if counts[o] > 0]
        target = max(beside, key=lambda o: (counts[o], -o)) if beside else 0
        counts[target] += counts[s]
        counts[s] = 0
        now[now == s] = target
    return now.tolist()


def merge_sectors(points: DataFrame, key: str, column: str, least: int = SECTOR_POINTS) -> DataFrame:
    """`points` with sectors (0 to 8, in `column`) of too few points folded into the fuller of their neighbours or the middle, the smallest first.

    Only the nine counts of a key meet in one row; points are never gathered.
    """

    @F.pandas_udf("array<int>")
    def mapped(counts: pd.Series) -> pd.Series:
        return pd.Series([_merged_sectors(np.array(c), least) for c in counts])

    counts = points.groupBy(key).agg(F.array(*[F.count_if(F.col(column) == s) for s in range(9)]).alias("_c"))
    targets = counts.select(key, mapped("_c").alias("_t"))
    return points.join(targets, key).withColumn(column, F.get("_t", F.col(column))).drop("_t")


@F.pandas_udf(T.BooleanType())
def _sees(ring: pd.Series, x: pd.Series, y: pd.Series, nx: pd.Series, ny: pd.Series) -> pd.Series:
    rows = zip(ring, x, y, nx, ny, strict=True)
    return pd.Series([bool(np.hypot(c - a, d - b) <= 1e-6 or covered(shapes._ring(r), np.array([a, b]), np.array([c, d]))) for r, a, b, c, d in rows], dtype=bool)


def claimed(points: DataFrame, names: DataFrame, rings: DataFrame, key: str) -> DataFrame:
    """(key, pt, name): each point (key, pt, x, y, width) with the nearest name (key, nid, name, x, y, run, channel) that may claim it.

    A name reaches 1.25 times its own narrowest run (250 to 6,000 m, a channel at most 1,000), over water at most 2.5 times as wide, along a
    line that stays inside the ring (key, ring). Of names as near the smaller nid. Names are posted under the cells they can reach.
    """
    limit = F.least(F.greatest(NAME_PART * F.col("run"), F.lit(NAME_LEAST_M)), F.lit(NAME_MOST_M))
    n = names.select(key, "nid", "name", F.col("x").alias("_x"), F.col("y").alias("_y"), "run", F.when(F.col("channel"), F.least(limit, F.lit(CHANNEL_MOST_M))).otherwise(limit).alias("_l"))
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("_l")) / NAME_MOST_M), F.floor((F.col(c) + F.col("_l")) / NAME_MOST_M)))
    n = n.withColumn("_gx", span("_x")).withColumn("_gy", span("_y"))
    p = points.withColumn("_gx", F.floor(F.col("x") / NAME_MOST_M)).withColumn("_gy", F.floor(F.col("y") / NAME_MOST_M))
    gap = F.sqrt(F.pow(F.col("_x") - F.col("x"), 2) + F.pow(F.col("_y") - F.col("y"), 2))
    near = p.join(n, [key, "_gx", "_gy"]).withColumn("_d", gap).where((F.col("_d") <= F.col("_l")) & (F.col("width") <= WIDTH_FACTOR * F.greatest("run", F.lit(1.0))))
    seen = near.join(rings.select(key, "ring"), key).where(_sees("ring", "x", "y", "_x", "_y"))
    return seen.groupBy(key, "pt").agg(F.min_by("name", F.struct("_d", "nid")).alias("name"))


def mask_fetches(points: DataFrame, polygons: DataFrame, key: str, bins: int = 16, arc: bool = True, cap: float = FETCH_CAP_M, cell: float = 25_000.0, most: int = 20_000) -> DataFrame:
    """(key, fetch): for each point (key, x, y) the mean distance of each bin's rays to the first land over all polygons (pid, ring, artificial).

    A border between waters is no land; a ray that leaves on an artificial edge (array<boolean> beside the ring, null: none) counts as the cap. Rings are
    simple; a further column `holes` (array of rings) takes islands, which are land. A null ring or one of fewer than three corners is no water.
    Points meet in cells, the polygons of a cell are those whose boxes are within the cap of it, so a task holds the waters around one cell and
    about `most` points; a cell with more is dealt over as many groups as that takes. No key may be given twice. Points at one place cast their rays
    once, and of equal polygons one takes part.
    """
    bearings = np.array([b * 360.0 / bins + o for b in range(bins) for o in (ARC if arc else [0.0])])
    holed = "holes" in polygons.columns

    def run(asked: pd.DataFrame, waters: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({key: [], "fetch": []})
        shapes_of = []
        for ring, flags, holes in zip(waters["ring"], waters["artificial"], waters["holes"] if holed else [None] * len(waters), strict=True):
            inner = [shapes._ring(h) for h in (holes if holes is not None else []) if len(h) > 2]
            shapes_of.append(([shapes._ring(ring), *inner], [flags, *[None] * len(inner)]))
        far = rays.Shores(shapes_of).fetches(asked[["x", "y"]].to_numpy(float), bearings, cap)
        return pd.DataFrame({key: asked[key], "fetch": list(far.reshape(len(asked), bins, -1).mean(2))})

    polygons = shapes.once(polygons.where(F.size("ring") > 2), "pid", "artificial", *(["holes"] if holed else []))
    every, points = points.select(key, "x", "y"), points.groupBy("x", "y").agg(F.min(key).alias(key))
    p = points.select(key, "x", "y", F.floor(F.col("x") / cell).alias("_gx"), F.floor(F.col("y") / cell).alias("_gy"))
    groups = p.groupBy("_gx", "_gy").agg(F.ceil(F.count("*") / most).alias("_n"))
    p = p.join(groups, ["_gx", "_gy"]).withColumn("_salt", F.pmod(F.xxhash64(key), F.col("_n"))).drop("_n")
    at = lambda f, axis, by: F.floor((f(F.transform("ring", lambda q: q[axis])) + by) / cell)
    span = lambda axis: F.explode(F.sequence(at(F.array_min, axis, -cap), at(F.array_max, axis, cap)))
    # Only cells that hold points take polygons, and only ids are spread over cells before that.
    cells = groups.select("_gx", "_gy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_salt"))
    posted = polygons.select("pid", "ring", span("x").alias("_gx")).select("pid", "_gx", span("y").alias("_gy")).join(cells, ["_gx", "_gy"])
    around = posted.join(polygons, "pid")
    kind = dict(points.dtypes)[key]
    found = p.groupBy("_gx", "_gy", "_salt").cogroup(around.groupBy("_gx", "_gy", "_salt")).applyInPandas(run, f"{key} {kind}, fetch array<double>")
    first = points.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col(key).alias("_first"))
    members = every.join(first, F.col("x").eqNullSafe(F.col("_x")) & F.col("y").eqNullSafe(F.col("_y"))).select(key, "_first")
    return members.join(found.withColumnRenamed(key, "_first"), "_first").select(key, "fetch")


def label_ids(points: DataFrame, key: str, label: str) -> DataFrame:
    """`points` with `label_id`: the place of their label in the order of all labels of the key, from 0."""
    ids = points.select(key, label).distinct().withColumn("label_id", F.dense_rank().over(Window.partitionBy(key).orderBy(label)) - 1)
    return points.join(ids, [key, label], "left")
