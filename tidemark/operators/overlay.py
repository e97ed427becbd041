"""Unions, intersections and differences of polygons with holes, and what columns of such polygons need: area, containment, parts.

A shape is an array of polygons, a polygon an array of rings (struct<x, y>; the outer one first, then holes), as in GeoJSON but unclosed. Overlays are computed on
an arrangement: all edges are rounded to `GRID` and cut where they meet, and each piece is kept if the result lies on just one side of it. How many
polygons lie on either side follows from the pieces that a ray from its middle crosses, so coincident and touching edges need no special case.

Arrangements work on a pair of shapes, or on a bounded number of them; `dissolved` unites any number by rounds of such bounded groups.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import shapes
from tidemark.storage import kept

RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
SHAPE = T.ArrayType(T.ArrayType(RING))
ARROW = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
#: Coordinates are rounded to this part of a unit; shapes that one group unites at a time; pairs of edges looked at in one go.
GRID, FAN, PAIRS = 1e-6, 32, 1 << 20


def polygon(ring: Column, holes: Column | None = None) -> Column:
    """A shape of one polygon out of its rings; empty for a null ring or one of fewer than three corners."""
    rings = F.array(ring) if holes is None else F.concat(F.array(ring), F.coalesce(holes, F.array().cast(T.ArrayType(RING))))
    return F.when(F.size(ring) > 2, F.array(rings)).otherwise(F.array().cast(SHAPE)).cast(SHAPE)


def area(shape: Column) -> Column:
    """Area of a shape: outer rings less holes."""
    one = lambda rings: F.aggregate(F.transform(rings, lambda r, i: F.when(i == 0, shapes.area(r)).otherwise(-shapes.area(r))), F.lit(0.0), lambda s, a: s + a)
    return F.aggregate(F.transform(shape, one), F.lit(0.0), lambda s, a: s + a)


def contains(shape: Column, x: Column, y: Column) -> Column:
    """Whether a shape holds a point: an odd number of the rings of one of its polygons does."""
    return F.exists(shape, lambda rings: F.size(F.filter(rings, lambda r: shapes.contains(r, x, y))) % 2 == 1)


def parts(shape: Column, least: float = 0.0) -> Column:
    """A shape's polygons of `least` area or more."""
    return F.filter(shape, lambda rings: area(F.array(rings)) >= least)


def _edges(shape: list, group: int) -> list[np.ndarray]:
    """Rows (x1, y1, x2, y2, group) with the water on the left, on the grid."""
    out = []
    for rings in shape:
        for i, points in enumerate(rings):
            if points is None or len(points) < 3:
                continue
            xy = np.rint((points if isinstance(points, np.ndarray) and points.ndim == 2 else shapes._ring(points)) / GRID)
            to = np.roll(xy, -1, 0)
            d, e = xy - xy[0], to - xy[0]
            if ((d[:, 0] * e[:, 1] - e[:, 0] * d[:, 1]).sum() > 0) != (i == 0):
                xy, to = to, xy
            out.append(np.column_stack([xy, to, np.full(len(xy), group)]))
    return out


def _near(low: np.ndarray, high: np.ndarray):
    """(i, j), i < j, of boxes that touch, in bounded lots: along x by order, then by test of y."""
    order = np.argsort(low[:, 0], kind="stable")
    low, high = low[order], high[order]
    last = np.searchsorted(low[:, 0], high[:, 0], side="right")
    n = np.maximum(last - np.arange(len(low)) - 1, 0)
    ends = np.cumsum(n)
    first = 0
    while first < len(n):
        to = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS)), first + 1)
        i = np.repeat(np.arange(first, to), n[first:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n[first:to]) - n[first:to], n[first:to])
        meet = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        yield order[i[meet]], order[j[meet]]
        first = to


def _cut(edges: np.ndarray) -> np.ndarray:
    """The edges in pieces that meet at their ends alone. Cuts are rounded to the grid, which may bend a piece into another, so it is done until nothing changes."""
    for _ in range(8):
        a, b = edges[:, :2], edges[:, 2:4]
        at, t = [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, j in _near(np.minimum(a, b), np.maximum(a, b)):
            p, d, q, e = a[i], b[i] - a[i], a[j], b[j] - a[j]
            cross = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
            dd, ee = (d**2).sum(1), (e**2).sum(1)
            sloped = np.abs(cross) > 1e-14 * np.sqrt(dd * ee)
            safe = np.where(sloped, cross, 1.0)
            u = ((q - p)[:, 0] * e[:, 1] - (q - p)[:, 1] * e[:, 0]) / safe
            v = ((q - p)[:, 0] * d[:, 1] - (q - p)[:, 1] * d[:, 0]) / safe
            hit = sloped & (u > -1e-12) & (u < 1 + 1e-12) & (v > -1e-12) & (v < 1 + 1e-12)
            at += [i[hit], j[hit]]
            t += [u[hit], v[hit]]
            # Ends that lie on the other edge, as along edges that run on one line.
            for own, s, w, ww, r in ((i, p, d, dd, q), (i, p, d, dd, q + e), (j, q, e, ee, p), (j, q, e, ee, p + d)):
                along = ((r - s) * w).sum(1) / ww
                on = (np.abs((r - s)[:, 0] * w[:, 1] - (r - s)[:, 1] * w[:, 0]) <= 0.5 * np.sqrt(ww)) & (along > 0) & (along < 1)
                at.append(own[on])
                t.append(along[on])
        at, t = np.concatenate(at), np.concatenate(t)
        n = len(edges)
        at, t = np.concatenate([np.arange(n), at, np.arange(n)]), np.concatenate([np.zeros(n), np.clip(t, 0, 1), np.ones(n)])
        order = np.lexsort((t, at))
        at, t = at[order], t[order]
        point = np.where(t[:, None] == 1, b[at], np.rint(a[at] + t[:, None] * (b - a)[at]))
        step = np.flatnonzero((at[1:] == at[:-1]) & (point[1:] != point[:-1]).any(1))
        new = np.column_stack([point[step], point[step + 1], edges[at[step], 4]])
        if len(new) == len(edges):
            return new
        edges = new
    return edges


def _pieces(edges: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, each once and from its lesser end; (groups, pieces): how often a group has it in this direction less how often in the other)."""
    turned = (edges[:, 0] > edges[:, 2]) | ((edges[:, 0] == edges[:, 2]) & (edges[:, 1] > edges[:, 3]))
    canon = np.where(turned[:, None], edges[:, [2, 3, 0, 1]], edges[:, :4])
    pieces, which = np.unique(canon, axis=0, return_inverse=True)
    net = np.zeros((groups, len(pieces)))
    np.add.at(net, (edges[:, 4].astype(int), which.reshape(-1)), np.where(turned, -1, 1))
    some = net.any(0)
    return pieces[some], net[:, some]


def _sides(pieces: np.ndarray, net: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many polygons of each group lie on the left and on the right of each piece: (groups, pieces) each."""
    p, q = pieces[:, :2], pieces[:, 2:]
    mid = (p + q) / 2
    rise = q[:, 1] - p[:, 1]
    around = np.zeros_like(net)
    low, high = np.minimum(p[:, 1], q[:, 1]), np.maximum(p[:, 1], q[:, 1])
    order = np.argsort(mid[:, 1], kind="stable")
    heights = mid[order, 1]
    first, last = np.searchsorted(heights, low, side="left"), np.searchsorted(heights, high, side="left")  # middles with low <= y < high
    n = np.where(rise != 0, last - first, 0)
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS)), at + 1)
        j = np.repeat(np.arange(at, to), n[at:to])
        i = order[np.repeat(first[at:to], n[at:to]) + np.arange(len(j)) - np.repeat(np.cumsum(n[at:to]) - n[at:to], n[at:to])]
        x = p[j, 0] + (mid[i, 1] - p[j, 1]) / rise[j] * (q[j, 0] - p[j, 0])
        hit = (i != j) & (x > mid[i, 0])
        for g in range(len(net)):
            around[g] += np.bincount(i[hit], net[g, j[hit]] * np.sign(rise[j[hit]]), len(n))
        at = to
    up = rise > 0  # on the right of an upward piece the ray starts free of it; on the left of others
    left = np.where(up, around + net, around)
    return left, left - net


def _rings(edges: np.ndarray) -> list[np.ndarray]:
    """Closed rings out of directed pieces: at each corner the sharpest turn to the left; a ring that comes by a corner twice is parted there."""
    start = {}
    for k, (x, y) in enumerate(map(tuple, edges[:, :2])):
        start.setdefault((x, y), []).append(k)
    turn = np.arctan2(edges[:, 3] - edges[:, 1], edges[:, 2] - edges[:, 0])
    free, out = np.ones(len(edges), bool), []
    for k in range(len(edges)):
        path: list[tuple] = []
        seen: dict[tuple, int] = {}
        while free[k]:
            free[k] = False
            here = tuple(edges[k, :2])
            if here in seen:
                out.append(np.array(path[seen[here] :]))
                for c in path[seen[here] :]:
                    del seen[c]
                path = path[: path.index(here)]
            seen[here] = len(path)
            path.append(here)
            options = [o for o in start.get(tuple(edges[k, 2:4]), []) if free[o]]
            if not options:
                break
            back = turn[k] + np.pi
            k = min(options, key=lambda o: (back - turn[o]) % (2 * np.pi))
        if path:
            out.append(np.array(path))
    return out


def _simple(ring: np.ndarray) -> np.ndarray:
    """Without corners on a straight line."""
    while len(ring) > 2:
        before, after = ring - np.roll(ring, 1, 0), np.roll(ring, -1, 0) - ring
        bent = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]) > 0.5 * np.hypot(*(before + after).T)
        if bent.all():
            break
        ring = ring[bent]
    return ring


def _inside(ring: np.ndarray, at: np.ndarray) -> bool:
    p, q = ring, np.roll(ring, -1, 0)
    spans = (p[:, 1] > at[1]) != (q[:, 1] > at[1])
    return bool((at[0] < p[spans, 0] + (at[1] - p[spans, 1]) / (q[spans, 1] - p[spans, 1]) * (q[spans, 0] - p[spans, 0])).sum() % 2)


def combined(groups: list[list], wanted: Callable[..., np.ndarray]) -> list[list[np.ndarray]]:
    """The shape of all places that `wanted` says yes to, given for each group how many of its polygons hold the place; in a fixed order."""
    return _shaped(*_arranged(groups), wanted)


def _arranged(groups: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pieces, how many polygons of each group lie on the left of each, and on the right): the arrangement that all kinds of overlays are read from."""
    found = [e for g, some in enumerate(groups) for shape in some for e in _edges(shape, g)]
    if not found:
        return np.zeros((0, 4)), np.zeros((len(groups), 0)), np.zeros((len(groups), 0))
    pieces, net = _pieces(_cut(np.concatenate(found)), len(groups))
    return pieces, *_sides(pieces, net)


def _shaped(pieces: np.ndarray, left: np.ndarray, right: np.ndarray, wanted: Callable[..., np.ndarray]) -> list[list[np.ndarray]]:
    if not len(pieces):
        return []
    l_in, r_in = wanted(*left), wanted(*right)
    edges = np.concatenate([pieces[l_in & ~r_in], pieces[r_in & ~l_in][:, [2, 3, 0, 1]]])
    area2 = lambda r: float(((r[:, 0] - r[0, 0]) * np.roll(r[:, 1] - r[0, 1], -1) - np.roll(r[:, 0] - r[0, 0], -1) * (r[:, 1] - r[0, 1])).sum())
    rings = [(area2(r), r) for r in map(_simple, _rings(edges)) if len(r) > 2]
    outer = sorted(((a, r) for a, r in rings if a > 0), key=lambda x: (x[0], x[1].min(0).tolist()))
    holes: dict[int, list[np.ndarray]] = {}
    for a, r in rings:
        if a < 0:  # the smallest outer ring around the hole; its first side's middle is on no other ring
            mid = (r[0] + r[1]) / 2
            home = next((k for k, (size, o) in enumerate(outer) if size > -a and _inside(o, mid)), None)
            if home is not None:
                holes.setdefault(home, []).append(r)
    started = lambda r: np.roll(r, -int(np.lexsort((r[:, 1], r[:, 0]))[0]), 0) * GRID
    out = [[started(o), *sorted((started(h) for h in holes.get(k, [])), key=lambda h: h[0].tolist())] for k, (_, o) in enumerate(outer)]
    return sorted(out, key=lambda rings: rings[0][0].tolist())


#: What belongs to a result, by how many polygons of the left and of the right shape hold a place.
KINDS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "union": lambda a, b: (a > 0) | (b > 0),
    "intersection": lambda a, b: (a > 0) & (b > 0),
    "difference": lambda a, b: (a > 0) & (b <= 0),
    "symmetric_difference": lambda a, b: (a > 0) != (b > 0),
}


def _rows(shape: list[list[np.ndarray]]) -> list:
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings] for rings in shape]


def overlaid(kind: str):
    """A function of two shape columns: their union, intersection, difference or symmetric_difference, a null shape being empty."""
    wanted = KINDS[kind]

    @F.arrow_udf(SHAPE)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        one = lambda s: [s.as_py()] if s.is_valid else []
        return pa.array([_rows(combined([one(x), one(y)], wanted)) for x, y in zip(a, b, strict=True)], ARROW)

    return run


def _ring_area(ring: np.ndarray) -> float:
    d = ring - ring[0]
    e = np.roll(d, -1, 0)
    return abs(float((d[:, 0] * e[:, 1] - e[:, 0] * d[:, 1]).sum())) / 2


def measured():
    """A function of two shape columns: struct of the area of each of KINDS and of `rest`, what the right shape has alone, and the number of `holes` in the rest.

    All are read from one arrangement, and no shape leaves the function, so a batch takes little memory.
    """
    kinds = {**KINDS, "rest": lambda a, b: (b > 0) & (a <= 0)}
    schema = T.StructType([*[T.StructField(k, T.DoubleType()) for k in kinds], T.StructField("holes", T.IntegerType())])

    def one(a: pa.Scalar, b: pa.Scalar) -> dict:
        arranged = _arranged([[s.as_py()] if s.is_valid else [] for s in (a, b)])
        found = {k: _shaped(*arranged, wanted) for k, wanted in kinds.items()}
        areas = {k: sum(_ring_area(r) * (1 if i == 0 else -1) for rings in shape for i, r in enumerate(rings)) for k, shape in found.items()}
        return {**{k: float(v) for k, v in areas.items()}, "holes": sum(len(rings) - 1 for rings in found["rest"])}

    @F.arrow_udf(schema)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = [one(x, y) for x, y in zip(a, b, strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[f.name] for r in rows], pa.int32() if f.name == "holes" else pa.float64()) for f in schema], [f.name for f in schema])

    return run


@F.arrow_udf(SHAPE)
def _united(several: pa.Array) -> pa.Array:
    return pa.array([_rows(combined([[s for s in some.as_py() if s is not None]], lambda n: n > 0)) for some in several], ARROW)


def dissolved(rows: DataFrame, key: str, shape: str) -> DataFrame:
    """(key, shape): the union of all shapes of each key; an empty one where all are null or empty.

    Shapes are united by groups of `FAN` that follow each other from west to east, round by round, until a key has one group; no task ever holds more than one
    group's shapes. The last union of a key is as large as its result.
    """
    left = F.coalesce(F.array_min(F.flatten(F.transform(F.col(shape), lambda rings: F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["x"])))))), F.lit(0.0))
    now = rows.select(key, F.col(shape).alias("shape"), left.alias("_x"))
    place, group = F.row_number().over(Window.partitionBy(key).orderBy("_x")), F.floor((F.col("_n") - 1) / FAN)
    while True:
        now = kept(now.withColumn("_n", place).groupBy(key, group.alias("_g")).agg(F.min("_x").alias("_x"), F.collect_list("shape").alias("_s")).select(key, "_x", _united("_s").alias("shape")))
        if now.groupBy(key).count().where("count > 1").isEmpty():
            return now.select(key, "shape")
