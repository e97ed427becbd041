"""Edges of water polygons: which of them other polygons share, and which are straight for so long that no shore is."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import shapes

#: Metres that a straight run's corners may be off its chord, its least length, and the spacing of places where one is tried to begin.
OFFSET_M, RUN_M, STRIDE_M = 10.0, 2_000.0, 250.0


def edge_rows(polygons: DataFrame) -> DataFrame:
    """(pid, ring_no, edge_no, x1, y1, x2, y2, length): the sides of the rings (pid, ring, holes or none) in order; ring 0 is the outer one."""
    rings = F.array("ring") if "holes" not in polygons.columns else F.concat(F.array("ring"), F.coalesce("holes", F.array().cast(polygons.schema["holes"].dataType)))
    each = polygons.where(F.size("ring") > 1).select("pid", F.posexplode(rings).alias("ring_no", "_r")).select("pid", "ring_no", F.posexplode(shapes.edges(F.col("_r"))).alias("edge_no", "e"))
    out = each.select("pid", "ring_no", "edge_no", *[F.col(f"e.{end}.{axis}").alias(f"{axis}{n}") for n, end in ((1, "a"), (2, "b")) for axis in "xy"])
    return out.withColumn("length", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))


def _posted(edges: DataFrame, cell: float, angle: float, slack: float, wide: bool) -> DataFrame:
    """Edges with their direction (0 to 180 degrees) under the cells of their boxes, a bin of direction and one of distance from the cell's corner; `wide`: and the bins beside."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    out = edges.where("length > 0").withColumn("_t", F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0)))
    cells = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - slack) / cell), F.floor((F.greatest(a, b) + slack) / cell)))
    out = out.withColumn("_gx", cells("x1", "x2")).withColumn("_gy", cells("y1", "y2"))
    bins = round(180 / angle)
    own = F.floor(F.col("_t") / angle)
    near = F.array_distinct(F.transform(F.sequence(own - 1, own + 1), lambda b: F.pmod(b, F.lit(bins)))) if wide else F.array(F.pmod(own, F.lit(bins)))
    out = out.withColumn("_b", F.explode(near))
    # How far the edge runs from the cell's corner, seen across the bin's middle direction; within a cell, directions of a bin and its neighbours differ by a few hundredths of it.
    mid = F.radians((F.col("_b") + 0.5) * angle)
    across = F.col("_gy") * -cell * F.cos(mid) + F.col("_gx") * cell * F.sin(mid)
    ends = [F.col(f"y{n}") * F.cos(mid) - F.col(f"x{n}") * F.sin(mid) + across for n in (1, 2)]
    width = cell / 16
    # An edge longer than the cell leaves it; only what it can be within the cell counts.
    reach = 1.5 * cell
    low, high = F.greatest(F.least(*ends) - slack, F.lit(-reach)), F.least(F.greatest(*ends) + slack, F.lit(reach))
    return out.withColumn("_d", F.explode(F.when(low <= high, F.sequence(F.floor(low / width), F.floor(high / width))).otherwise(F.array().cast("array<bigint>"))))


def shared_edges(edges: DataFrame, cell: float = 1_000.0, tolerance: float = 0.01) -> DataFrame:
    """(pid, ring_no, edge_no, other, start, end): the stretches of each edge, in metres from its beginning, that run along an edge of another polygon within the tolerance.

    Edges on one line overlap whether or not they have ends in common. They meet by cell, direction and distance from the cell's corner, so that a crowded cell is
    no product of all its edges; each pair counts once.
    """
    keys = ["_gx", "_gy", "_b", "_d"]
    mine = _posted(edges, cell, 2.0, tolerance, True)
    others = _posted(edges, cell, 2.0, tolerance, False).select(*keys, F.col("pid").alias("other"), F.col("ring_no").alias("_r"), F.col("edge_no").alias("_e"), *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    # Spark takes posted edges for as small as the file they come from and would send all of them to the driver.
    pairs = mine.hint("merge").join(others.hint("merge"), keys).where(F.col("pid") != F.col("other"))
    ux, uy = (F.col("x2") - F.col("x1")) / F.col("length"), (F.col("y2") - F.col("y1")) / F.col("length")
    off = lambda n: F.abs((F.col(f"_x{n}") - F.col("x1")) * uy - (F.col(f"_y{n}") - F.col("y1")) * ux)
    along = lambda n: (F.col(f"_x{n}") - F.col("x1")) * ux + (F.col(f"_y{n}") - F.col("y1")) * uy
    start, end = F.greatest(F.least(along(1), along(2)), F.lit(0.0)), F.least(F.greatest(along(1), along(2)), F.col("length"))
    met = pairs.where((off(1) <= tolerance) & (off(2) <= tolerance)).select("pid", "ring_no", "edge_no", "other", "_r", "_e", start.alias("start"), end.alias("end"))
    return met.where(F.col("end") - F.col("start") > tolerance).distinct().drop("_r", "_e")


def internal_edges(edges: DataFrame, cell: float = 1_000.0, tolerance: float = 0.01) -> DataFrame:
    """`edges` with shared_m, the metres that other polygons share (each once), and internal, whether that is all of the edge: a border between waters, no shore."""
    key = ["pid", "ring_no", "edge_no"]
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    add = lambda s, x: F.struct((s["m"] + F.greatest(x["end"] - F.greatest(x["start"], s["to"]), F.lit(0.0))).alias("m"), F.greatest(s["to"], x["end"]).alias("to"))
    total = F.aggregate(spans, F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("to")), add, lambda s: s["m"])
    shared = shared_edges(edges, cell, tolerance).groupBy(*key).agg(total.alias("shared_m"))
    out = edges.join(shared, key, "left").withColumn("shared_m", F.coalesce("shared_m", F.lit(0.0)))
    return out.withColumn("internal", (F.col("length") > 0) & (F.col("shared_m") >= F.col("length") - 2 * tolerance))


def straight(xy: np.ndarray, offset: float = OFFSET_M, least: float = RUN_M, stride: float = STRIDE_M) -> np.ndarray:
    """Which sides of a ring belong to a run, `least` metres long or more, whose corners are within `offset` of its chord; runs are tried from every `stride` metres.

    Each corner allows the chord a fan of directions, and a run goes on while its next corner lies in all fans so far: two running bounds instead of a test of every chord.
    """
    n = len(xy)
    if n < 2:
        return np.zeros(n, bool)
    p = np.vstack([xy, xy[:1]])
    gone = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
    out = np.zeros(n, bool)
    if gone[-1] < least:
        return out
    tried = np.unique(np.maximum(np.searchsorted(gone, np.arange(0.0, gone[-1] - least + 1e-9, stride), side="right") - 1, 0))
    reached, corners, lengths = 0, p.tolist(), gone.tolist()
    for i in tried.tolist():
        if i < reached:
            continue
        j = bisect.bisect_left(lengths, lengths[i] + least)
        if j > n:
            break
        end = _run(corners, i, j, offset)
        if end:
            reached = end
            out[i:reached] = True
    return out


def _run(p: list, i: int, j: int, offset: float) -> int:
    """The corner at which the run from corner i, which takes in corner j at least, ends; 0 if there is none. It looks no further than the run, or than a chord is possible."""
    x, y = p[i]
    # Directions of lines, from the first chord's: both ways along a line are the same.
    zero, low, high = math.atan2(p[j][1] - y, p[j][0] - x), -math.inf, math.inf
    for m in range(i + 1, len(p)):
        dx, dy = p[m][0] - x, p[m][1] - y
        far = math.hypot(dx, dy)
        turn = (math.atan2(dy, dx) - zero + math.pi / 2) % math.pi - math.pi / 2
        if m >= j and not (far > 0 and low - 1e-12 <= turn <= high + 1e-12):
            return m - 1 if m > j else 0
        fan = math.asin(min(offset / far, 1.0)) if far > offset else math.inf
        low, high = max(low, turn - fan), min(high, turn + fan)
        if m < j and low > high + 1e-11:
            return 0
    return len(p) - 1


def straight_edges(offset: float = OFFSET_M, least: float = RUN_M, stride: float = STRIDE_M):
    """A function of a ring column: array<boolean> beside it, true for the sides on long straight runs, which are clip lines and breakwaters; as `artificial` of `mask_fetches`."""

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def run(rings: pa.Array) -> pa.Array:
        xy, sizes = shapes.flat(rings)
        ends = np.cumsum(sizes)
        flags = [straight(xy[end - n : end], offset, least, stride) for end, n in zip(ends, sizes, strict=True)]
        offsets = pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[~rings.is_valid().to_numpy(zero_copy_only=False), False])
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, bool), *flags])))

    return run


def not_internal(ring_flags: Column, internal: Column) -> Column:
    """Flags of artificial sides without those that are borders between waters."""
    return F.zip_with(ring_flags, internal, lambda a, b: a & ~b)
