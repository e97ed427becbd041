"""Planar polygons (rings of struct<x, y>, metres): area, containment, sampling, longest runs and rays.

Area and containment are Columns. Scan lines and rays need loops over edges, so they are vectorised functions over Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Corners, and crossings of edges and scan lines, that are worked on at a time, about.
CORNERS = 1 << 18


def held(value: Column, f) -> Column:
    """f of a value that is computed once, as a lambda's variable, however often f uses it."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def edges(ring: Column) -> Column:
    """array<struct<a, b>>: the sides of a ring, closed."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def area(ring: Column) -> Column:
    """Area by the shoelace formula."""
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))) / 2


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside, by counting the sides that a ray to the right crosses."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        return spans & (x < a["x"] + (y - a["y"]) / F.when(spans, b["y"] - a["y"]) * (b["x"] - a["x"]))

    return F.size(F.filter(edges(ring), lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def once(polygons: DataFrame, key: str, *also: str) -> DataFrame:
    """`polygons` with each ring (and what else is given with it) once, under its smallest key: what follows from rings alone grows with the different ones."""
    return polygons.groupBy("ring", *also).agg(F.min(key).alias(key)).select(key, "ring", *also)


def containing(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """(id, pid): each point of `points` (id, x, y) with the smallest pid of the polygons (pid, ring) that hold it.

    Polygons are posted under the grid cells of their boxes, so a point meets only polygons nearby. Points at one place ask once, and of equal rings the first counts.
    """
    polygons, places = once(polygons, "pid"), points.select("x", "y").distinct()
    side = lambda f, axis: f(F.transform("ring", lambda p: p[axis]))
    boxed = polygons.withColumns({"_w": side(F.array_min, "x"), "_e": side(F.array_max, "x"), "_s": side(F.array_min, "y"), "_n": side(F.array_max, "y")})
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    posted, in_box = boxed.withColumn("gx", cells("_w", "_e")).withColumn("gy", cells("_s", "_n")), F.col("x").between(F.col("_w"), F.col("_e")) & F.col("y").between(F.col("_s"), F.col("_n"))
    asks = places.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
    found = asks.join(posted, ["gx", "gy"]).where(in_box).where(contains(F.col("ring"), F.col("x"), F.col("y"))).groupBy("x", "y").agg(F.min("pid").alias("pid"))
    return points.join(found, ["x", "y"]).groupBy("id").agg(F.min("pid").alias("pid"))


def sampled(polygons: DataFrame, spacing: float) -> DataFrame:
    """(pid, x, y): the nodes of a common grid that lie inside each polygon."""
    at = lambda f, axis, g: g(f(F.transform("ring", lambda p: p[axis])) / spacing).cast("long")
    nodes = polygons.withColumn("i", F.explode(F.sequence(at(F.array_min, "x", F.ceil), F.greatest(at(F.array_min, "x", F.ceil), at(F.array_max, "x", F.floor)))))
    nodes = nodes.withColumn("j", F.explode(F.sequence(at(F.array_min, "y", F.ceil), F.greatest(at(F.array_min, "y", F.ceil), at(F.array_max, "y", F.floor)))))
    nodes = nodes.select("pid", "ring", (F.col("i") * spacing).alias("x"), (F.col("j") * spacing).alias("y"))
    return nodes.where(contains(F.col("ring"), F.col("x"), F.col("y"))).select("pid", "x", "y")


def _ring(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], float)


def flat(rings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the corners of all rings of an Arrow array, one ring after another; how many each has, a null one none)."""
    points = rings.flatten()
    x, y = (points.flatten()[points.type.get_field_index(axis)].to_numpy(zero_copy_only=False).astype(float) for axis in "xy")
    return np.column_stack([x, y]), rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def following(sizes: np.ndarray) -> np.ndarray:
    """The place of each corner's next one, rings lying one after another."""
    out = np.arange(1, int(sizes.sum()) + 1)
    ends = np.cumsum(sizes)[sizes > 0]
    out[ends - 1] = ends - sizes[sizes > 0]
    return out


def convex(xy: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each ring turns one way alone, and once around: any segment between two places of it lies inside."""
    who, after = np.repeat(np.arange(len(sizes)), sizes), following(sizes)
    d = xy[after] - xy
    e = d[after]
    cross, dot = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0], (d * e).sum(1)
    count = lambda flag: np.bincount(who[flag], minlength=len(sizes))
    around = np.bincount(who, np.arctan2(cross, dot), len(sizes))
    fits = ((count(cross < 0) == 0) | (count(cross > 0) == 0)) & (np.abs(np.abs(around) - 2 * np.pi) < 1e-6)
    return fits & (count(~(d != 0).any(1) | ((cross == 0) & (dot <= 0))) == 0) & (sizes > 2)


def _turned(xy: np.ndarray, degrees: float) -> np.ndarray:
    """Rotated so that the compass bearing `degrees` points along x."""
    a = np.radians(90 - degrees)
    return xy @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])


def longest_piece(xy: np.ndarray, bearing: float, spacing: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The longest stretch inside a ring along a bearing, over scan lines `spacing` apart, and its ends; all lines at once, from the edges that each crosses."""
    p = _turned(xy, bearing)
    q = np.roll(p, -1, 0)
    first = p[:, 1].min() + spacing / 2
    low, high = np.minimum(p[:, 1], q[:, 1]), np.maximum(p[:, 1], q[:, 1])
    start = np.maximum(np.floor((low - first) / spacing).astype(np.int64), 0)
    n = np.maximum(np.ceil((high - first) / spacing).astype(np.int64) + 1 - start, 0)
    edge = np.repeat(np.arange(len(p)), n)
    line = np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n) + start[edge]
    y = first + line * spacing
    cut = (p[edge, 1] > y) != (q[edge, 1] > y)
    edge, line, y = edge[cut], line[cut], y[cut]
    x = p[edge, 0] + (y - p[edge, 1]) / (q[edge, 1] - p[edge, 1]) * (q[edge, 0] - p[edge, 0])
    order = np.lexsort((x, line))  # a line crosses an even number of edges, so pairs never span lines
    x, y = x[order], y[order]
    runs = x[1::2] - x[::2]
    if not len(runs) or runs.max() <= 0:
        return 0.0, xy[0], xy[0]
    i = 2 * int(runs.argmax())
    ends = _turned(np.array([(x[i], y[i]), (x[i + 1], y[i])]), 180 - bearing)  # the turn back
    return float(runs.max()), ends[0], ends[1]


def longest_pieces(xy: np.ndarray, sizes: np.ndarray, ring: np.ndarray, bearing: np.ndarray, spacing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`longest_piece` of many rings (as from `flat`): lengths and ends (jobs, 2, 2) of the jobs (a ring's number, a bearing, a spacing), in lots of bounded size."""
    starts, lengths, ends = np.cumsum(sizes) - sizes, np.zeros(len(ring)), np.zeros((len(ring), 2, 2))
    lots = np.cumsum(sizes[ring]) // CORNERS
    for lot in np.split(np.arange(len(ring)), np.flatnonzero(np.diff(lots)) + 1):
        n = sizes[ring[lot]]
        who, after = np.repeat(np.arange(len(lot)), n), following(n)
        begins = np.cumsum(n) - n
        at = np.arange(len(who)) - begins[who] + starts[ring[lot]][who]
        a = np.radians(90 - bearing[lot])
        cos, sin = np.cos(a), np.sin(a)
        x, y = xy[at, 0] * cos[who] + xy[at, 1] * sin[who], xy[at, 1] * cos[who] - xy[at, 0] * sin[who]
        step = spacing[lot]
        first = np.minimum.reduceat(y, begins) + step / 2
        low, high = np.minimum(y, y[after]), np.maximum(y, y[after])
        start = np.maximum(np.floor((low - first[who]) / step[who]).astype(np.int64), 0)
        lines = np.maximum(np.ceil((high - first[who]) / step[who]).astype(np.int64) + 1 - start, 0)
        shares = np.cumsum(np.bincount(who, lines, len(lot))) // CORNERS
        for some in np.split(np.arange(len(lot)), np.flatnonzero(np.diff(shares)) + 1):
            corners = slice(begins[some[0]], begins[some[-1]] + n[some[-1]])
            edge = np.repeat(np.arange(corners.start, corners.stop), lines[corners])
            line = np.arange(len(edge)) - np.repeat(np.cumsum(lines[corners]) - lines[corners], lines[corners]) + start[edge]
            height = first[who[edge]] + line * step[who[edge]]
            cut = (y[edge] > height) != (y[after[edge]] > height)
            edge, line, height = edge[cut], line[cut], height[cut]
            place = x[edge] + (height - y[edge]) / (y[after[edge]] - y[edge]) * (x[after[edge]] - x[edge])
            order = np.lexsort((place, line, who[edge]))
            place, height, job = place[order], height[order], who[edge[order]][::2]
            runs = place[1::2] - place[::2]
            if not len(runs):
                continue
            jobs, began = np.unique(job, return_index=True)
            longest = np.maximum.reduceat(runs, began)
            is_longest = np.flatnonzero(runs == np.repeat(longest, np.diff(np.r_[began, len(runs)])))
            jobs, which = np.unique(job[is_longest], return_index=True)
            i = 2 * is_longest[which]
            c, s, some_length = cos[jobs], sin[jobs], runs[i // 2]
            good = some_length > 0
            lengths[lot[jobs[good]]] = some_length[good]
            for end in (0, 1):  # turned back
                back = np.column_stack([place[i + end] * c - height[i] * s, place[i + end] * s + height[i] * c])
                ends[lot[jobs[good]], end] = back[good]
    return lengths, ends


def longest_run(xy: np.ndarray, bearing: float, spacing: float) -> float:
    return longest_piece(xy, bearing, spacing)[0]


def extents(spacing: float, bearings: int = 16):
    """A function of a ring column: array<double>, the longest run at each of so many bearings."""
    half = [i * 360 / bearings for i in range(bearings // 2)]

    def one(points) -> list[float] | None:
        if points is None or len(points) < 3:
            return None
        xy = _ring(points)
        return [longest_run(xy, b, spacing) for b in half] * 2

    @F.pandas_udf("array<double>")
    def run(rings: pd.Series) -> pd.Series:
        return rings.map(one)

    return run


def fetches(cap: float, bearings: int = 16):
    """A function of (ring, x, y): array<double>, the distance from an inner point to the ring at each bearing, at most `cap`."""

    @F.pandas_udf("array<double>")
    def run(rings: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for r, x, y in zip(rings, xs, ys, strict=True):
            row, xy = [], _ring(r) - (x, y)
            for i in range(bearings):
                p = _turned(xy, i * 360 / bearings)
                q = np.roll(p, -1, 0)
                cut = (p[:, 1] > 0) != (q[:, 1] > 0)
                ahead = p[cut, 0] - p[cut, 1] / (q[cut, 1] - p[cut, 1]) * (q[cut, 0] - p[cut, 0])
                row.append(float(min([cap, *ahead[ahead > 0]])))
            out.append(row)
        return pd.Series(out)

    return run
