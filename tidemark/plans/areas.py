"""Queries over overlays, borders, straight runs and projected places, of rectangles and points made from whole tables; SQL has their closed forms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions import projection
from tidemark.operators import borders, overlay, reaches
from tidemark.plans.checks import read
from tidemark.plans.registry import query
from tidemark.plans.waters import _ring
from tidemark.storage import spread

_A = "(SELECT p_partkey AS id, CAST(p_partkey * 37 % 100 * 2 AS DOUBLE) AS x, CAST(p_partkey * 5 AS DOUBLE) AS y, 5.0::DOUBLE + p_partkey % 12 AS w, 4.0::DOUBLE + p_partkey % 9 AS h FROM part)"
_B = "(SELECT s_suppkey AS pid, CAST(s_suppkey * 3 % 100 * 2 AS DOUBLE) AS x, CAST(s_suppkey * 100 AS DOUBLE) AS y, 30.0::DOUBLE + s_suppkey % 20 AS w, 25.0::DOUBLE + s_suppkey % 30 AS h FROM supplier)"


@query(f"""WITH o AS (SELECT a.id, b.pid, a.w * a.h AS one, b.w * b.h AS two, (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS bb,
  a.x > b.x AND a.y > b.y AND a.x + a.w < b.x + b.w AND a.y + a.h < b.y + b.h AS within FROM {_A} a JOIN {_B} b ON a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h)
SELECT id, pid, round(one + two - bb, 4) AS united, round(bb, 4) AS shared, round(one - bb, 4) AS ours, round(two - bb, 4) AS theirs, round(one + two - 2 * bb, 4) AS either, CAST(within AS INTEGER) AS holes FROM o""")
def polygon_overlay(spark, d):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    a = read(spark, d, "part").select(k.alias("id"), _ring(k * 37 % 100 * 2, k * 5, 5 + k % 12, 4 + k % 9).alias("ring"))
    b = read(spark, d, "supplier").select(s.alias("pid"), _ring(s * 3 % 100 * 2, s * 100, 30 + s % 20, 25 + s % 30).alias("ring"))
    pairs = reaches.overlaps(a, b, 100.0).select("id", "pid").join(a.select("id", F.col("ring").alias("r1")), "id").join(b.select("pid", F.col("ring").alias("r2")), "pid")
    found = spread(pairs).select("id", "pid", overlay.measured()(overlay.polygon(F.col("r1")), overlay.polygon(F.col("r2"))).alias("m"))
    area = lambda kind: F.round(F.col(f"m.{kind}"), 4)
    return found.select(
        "id", "pid", area("union").alias("united"), area("intersection").alias("shared"), area("difference").alias("ours"), area("rest").alias("theirs"),
        area("symmetric_difference").alias("either"), F.col("m.holes").alias("holes"),
    )


@query("""WITH r AS (SELECT p_partkey // 50 AS body, p_partkey % 50 * 9 AS a, p_partkey % 50 * 9 + 5 + p_partkey * 7 % 12 AS b, 4 + p_partkey // 50 % 9 AS h FROM part),
s AS (SELECT *, a > coalesce(max(b) OVER (PARTITION BY body ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM r),
i AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY body ORDER BY a) AS island FROM s), j AS (SELECT body, island, CAST((max(b) - min(a)) * any_value(h) AS DOUBLE) AS area FROM i GROUP BY ALL)
SELECT body, CAST(count(*) AS INTEGER) AS n, round(sum(area), 4) AS area, round(coalesce(sum(area) FILTER (WHERE area >= 400), 0.0), 4) AS large FROM j GROUP BY body""")
def body_union(spark, d):
    k = F.col("p_partkey")
    body = F.floor(k / 50)
    rows = read(spark, d, "part").select(body.alias("body"), overlay.polygon(_ring(k % 50 * 9, F.lit(0), 5 + k * 7 % 12, 4 + body % 9)).alias("shape"))
    out = overlay.dissolved(rows, "body", "shape")
    return out.select("body", F.size("shape").alias("n"), F.round(overlay.area(F.col("shape")), 4).alias("area"), F.round(overlay.area(overlay.parts(F.col("shape"), 400.0)), 4).alias("large"))


@query("""WITH t AS (SELECT p_partkey AS pid, p_partkey % 100 AS c, p_partkey // 100 AS r FROM part WHERE p_partkey % 7 > 0), s AS (SELECT *, r * 10 + c % 2 * 5 AS y FROM t),
n AS (SELECT a.pid, a.c <> b.c AS beside, least(a.y, b.y) + 10 - greatest(a.y, b.y) AS m FROM s a JOIN s b ON (abs(a.c - b.c) = 1 AND abs(a.y - b.y) < 10) OR (a.c = b.c AND abs(a.y - b.y) = 10)),
m AS (SELECT pid, sum(CASE WHEN beside THEN m ELSE 10 END) AS m, count(*) FILTER (WHERE NOT beside) AS n FROM n GROUP BY pid), e AS (SELECT a.pid, b.c, sum(least(a.y, b.y) + 10 - greatest(a.y, b.y)) AS m FROM s a JOIN s b ON abs(a.c - b.c) = 1 AND abs(a.y - b.y) < 10 GROUP BY ALL)
SELECT s.pid, round(CAST(coalesce(m, 0) AS DOUBLE), 4) AS shared_m, coalesce(n, 0) + (SELECT count(*) FROM e WHERE e.pid = s.pid AND e.m = 10) AS internal FROM s LEFT JOIN m USING (pid)""")
def shared_borders(spark, d):
    k = F.col("p_partkey")
    c = k % 100
    tiles = read(spark, d, "part").where(k % 7 > 0).select(k.alias("pid"), _ring(c * 10, F.floor(k / 100) * 10 + c % 2 * 5, F.lit(10), F.lit(10)).alias("ring"))
    found = borders.internal_edges(borders.edge_rows(tiles), cell=50.0)
    return found.groupBy("pid").agg(F.round(F.sum("shared_m"), 4).alias("shared_m"), F.count_if("internal").alias("internal"))


@query("""SELECT p_partkey AS pid, CAST(10 * (CASE WHEN 500 * (1 + p_partkey % 10) >= 2000 THEN 1 ELSE 0 END + CASE WHEN 250 * (1 + p_partkey % 12) >= 2000 THEN 1 ELSE 0 END) AS INTEGER) AS sides FROM part""")
def straight_sides(spark, d):
    k = F.col("p_partkey")
    corners = _ring(k * 3 % 1000, k * 7 % 1000, 500 * (1 + k % 10), 250 * (1 + k % 12))
    fifth = lambda a, b, i: F.struct((a["x"] + (b["x"] - a["x"]) * i / 5).alias("x"), (a["y"] + (b["y"] - a["y"]) * i / 5).alias("y"))
    rows = spread(read(spark, d, "part").select("p_partkey")).select(k.alias("pid"), corners.alias("c"))
    fine = F.array(*[fifth(F.get("c", F.lit(i)), F.get("c", F.lit((i + 1) % 4)), j) for i in range(4) for j in range(5)])
    flags = rows.select("pid", borders.straight_edges()(fine).alias("flags"))
    return flags.select("pid", F.aggregate("flags", F.lit(0), lambda n, f: n + f.cast("int")).alias("sides"))


_C = projection.MEASURED.constants()
_G = math.radians(projection.MEASURED.grid)
_PLACE = "SELECT c_custkey, 41.5 + c_custkey * 37 % 6000 / 1000.0::DOUBLE AS lat, -90.5 + c_custkey * 53 % 8000 / 1000.0::DOUBLE AS lon FROM customer"


@query(f"""WITH p AS ({_PLACE}), t AS (SELECT *, {_C["h"]!r} / pow(tan(pi() / 4 - radians(lat) / 2) / pow((1 - {_C["e"]!r} * sin(radians(lat))) / (1 + {_C["e"]!r} * sin(radians(lat))), {_C["e"] / 2!r}), {_C["b"]!r}) AS q, {_C["b"]!r} * (radians(lon) - {_C["lon"]!r}) AS w FROM p),
u AS (SELECT *, ((q - 1 / q) / 2 * {_C["sin_g"]!r} - sin(w) * {_C["cos_g"]!r}) / ((q + 1 / q) / 2) AS part, {_C["a"] / _C["b"]!r} * atan2((q - 1 / q) / 2 * {_C["cos_g"]!r} + sin(w) * {_C["sin_g"]!r}, cos(w)) AS u FROM t),
v AS (SELECT *, {_C["a"] / (2 * _C["b"])!r} * ln((1 - part) / (1 + part)) AS v FROM u)
SELECT c_custkey, round(v * {math.cos(_G)!r} + u * {math.sin(_G)!r} + {projection.MEASURED.east!r}, 3) AS x, round(u * {math.cos(_G)!r} - v * {math.sin(_G)!r} + {projection.MEASURED.north!r}, 3) AS y, round(lat, 7) AS lat, round(lon, 7) AS lon FROM v""")
def grid_places(spark, d):
    k = F.col("c_custkey")
    p = read(spark, d, "customer").select("c_custkey", (41.5 + k * 37 % 6000 / 1000.0).alias("lat"), (-90.5 + k * 53 % 8000 / 1000.0).alias("lon"))
    p = p.withColumn("g", projection.to_grid(F.col("lat"), F.col("lon"))).withColumn("back", projection.from_grid(F.col("g.x"), F.col("g.y")))
    return p.select("c_custkey", F.round("g.x", 3).alias("x"), F.round("g.y", 3).alias("y"), F.round("back.lat", 7).alias("lat"), F.round("back.lon", 7).alias("lon"))
