"""Queries over scalar functions of winds, places, times, texts and verdicts, each over its whole tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import aero, geo, text, times, waves
from tidemark.operators import conditions, matching, rules
from tidemark.plans.checks import _nm, read
from tidemark.plans.registry import query


@query("""WITH w AS (SELECT event_id, CAST(event_id * 7 % 360 AS DOUBLE) AS deg, value AS kt, CAST(event_id * 13 % 180 AS DOUBLE) AS hd, CAST(event_id % 5000 AS DOUBLE) AS elev, 29 + CAST(event_id % 200 AS DOUBLE) / 100 AS alt, CAST(event_id % 40 - 5 AS DOUBLE) AS t FROM events)
SELECT event_id, round(kt * sin(radians(deg - hd)), 4) + 0.0::DOUBLE AS across, round(kt * cos(radians(deg - hd)), 4) + 0.0::DOUBLE AS along, round(elev + (29.92 - alt) * 1000, 4) AS pressure_ft,
  round(elev + (29.92 - alt) * 1000 + 120 * (t - (15 - 2 * (elev + (29.92 - alt) * 1000) / 1000)), 4) AS density_ft, round((t - 32) * 5 / 9, 4) AS f_to_c, round(t * 9 / 5 + 32, 4) AS c_to_f FROM w""")
def aero_numbers(spark, d):
    i = F.col("event_id")
    deg, hd, elev, alt, t = (i * 7 % 360).cast("double"), (i * 13 % 180).cast("double"), (i % 5000).cast("double"), 29 + (i % 200).cast("double") / 100, (i % 40 - 5).cast("double")
    four = lambda c, name: F.round(c, 4).alias(name)
    return read(spark, d, "events").select(
        "event_id", four(aero.crosswind(deg, F.col("value"), hd), "across"), four(aero.headwind(deg, F.col("value"), hd), "along"), four(aero.pressure_altitude_ft(elev, alt), "pressure_ft"),
        four(aero.density_altitude_ft(elev, alt, t), "density_ft"), four(aero.f_to_c(t), "f_to_c"), four(aero.c_to_f(t), "c_to_f"),
    )


@query("""WITH r AS (SELECT s_suppkey, s_suppkey % 18 * 10 AS h, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE CAST(s_suppkey % 20 AS DOUBLE) END AS kt, CAST(s_suppkey * 31 % 360 AS DOUBLE) AS deg FROM supplier),
e AS (SELECT s_suppkey, kt, deg, unnest([h, h + 180, (h + 90) % 360, (h + 270) % 360]) AS heading, unnest([3000, 3000, 2000 + s_suppkey % 2000, 2000 + s_suppkey % 2000]) AS len, unnest([0, 1, 2, 3]) AS place FROM r),
x AS (SELECT *, CASE WHEN kt <= 0 THEN 0 ELSE round_even(abs(kt * sin(radians(deg - heading))), 3) END AS across, CASE WHEN kt <= 0 THEN 0 ELSE -kt * cos(radians(deg - heading)) END AS along FROM e)
SELECT s_suppkey, CAST(arg_min(heading, (across, along, -len, place)) AS INTEGER) AS heading FROM x GROUP BY s_suppkey""")
def best_runway_end(spark, d):
    k = F.col("s_suppkey")
    strip = lambda name, h, length: F.struct(F.lit(name).alias("id"), h.cast("double").alias("heading"), length.cast("int").alias("length_ft"))
    ends = aero.runway_ends(F.array(strip("9/27", k % 18 * 10, F.lit(3000)), strip("N/S", (k % 18 * 10 + 90) % 360, 2000 + k % 2000)))
    kt = F.when(k % 4 == 0, F.lit(0.0)).otherwise((k % 20).cast("double"))
    return read(spark, d, "supplier").select("s_suppkey", aero.best_end(ends, (k * 31 % 360).cast("double"), kt)["heading"].alias("heading"))


@query(f"""WITH p AS (SELECT c_custkey, 41.6::DOUBLE + c_custkey * 37 % 680 / 100.0::DOUBLE AS lat, -90.5::DOUBLE + c_custkey * 53 % 820 / 100.0::DOUBLE AS lon, CAST(c_custkey * 7 % 720 - 180 AS DOUBLE) AS a, CAST(c_custkey * 11 % 360 AS DOUBLE) AS b FROM customer),
n AS (SELECT *, abs((a + 720) % 360 - b) AS x FROM p)
SELECT c_custkey, (a + 720) % 360 AS norm, least(x, 360 - x) AS diff, round(lat + 12 / 60.0::DOUBLE * cos(radians(b)), 6) AS lat2, round(lon + 12 / 60.0::DOUBLE * sin(radians(b)) / cos(radians(lat)), 6) AS lon2,
  round({_nm("lat", "lon", "least(greatest(lat, 43.0::DOUBLE), 44.0::DOUBLE)", "least(greatest(lon, -87.0::DOUBLE), -85.0::DOUBLE)")}, 4) AS box_nm, round(lat - 0.5, 6) AS south, round(lon + 0.5 / cos(radians(lat)), 6) AS east FROM n""")
def geo_numbers(spark, d):
    k = F.col("c_custkey")
    lat, lon, a, b = 41.6 + (k * 37 % 680) / 100.0, -90.5 + (k * 53 % 820) / 100.0, (k * 7 % 720 - 180).cast("double"), (k * 11 % 360).cast("double")
    there, box = geo.advance(lat, lon, b, F.lit(12.0)), geo.box_around(lat, lon, 30.0)
    return read(spark, d, "customer").select(
        "c_custkey", geo.norm360(a).alias("norm"), geo.angle_diff(a, b).alias("diff"), F.round(there["lat"], 6).alias("lat2"), F.round(there["lon"], 6).alias("lon2"),
        F.round(geo.box_distance_nm(lat, lon, F.lit(43.0), F.lit(-87.0), F.lit(44.0), F.lit(-85.0)), 4).alias("box_nm"), F.round(box["south"], 6).alias("south"), F.round(box["east"], 6).alias("east"),
    )


@query("""SELECT event_id, strftime(ts, '%m-%d') >= '11-15' OR strftime(ts, '%m-%d') <= '01-10' AS wrapped, strftime(ts, '%m-%d') BETWEEN '01-05' AND '01-20' AS plain, abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) <= 36000000000 AS fresh,
  CAST(CASE WHEN strftime(ts, '%H:%M') >= '10:30' THEN CAST(ts AS DATE) + 1 ELSE CAST(ts AS DATE) END AS VARCHAR)[1:10] AS target,
  round(greatest(0, least(epoch_us(ts) + 7200000000, epoch_us(date_trunc('day', ts) + INTERVAL 20 HOUR)) - greatest(epoch_us(ts), epoch_us(date_trunc('day', ts) + INTERVAL 8 HOUR))) / 7200000000.0::DOUBLE, 6) AS daylight FROM events""")
def time_predicates(spark, d):
    ts = F.col("ts")
    day = F.date_trunc("day", ts)
    part = times.overlap_fraction(ts, ts + F.expr("interval 2 hours"), day + F.expr("interval 8 hours"), day + F.expr("interval 20 hours"))
    return read(spark, d, "events").select(
        "event_id", times.in_season(ts, "11-15", "01-10").alias("wrapped"), times.in_season(ts, "01-05", "01-20").alias("plain"), times.fresh(ts, F.lit("2024-01-10 12:00:00").cast("timestamp"), 600).alias("fresh"),
        times.target_date(ts, "10:30").cast("string").alias("target"), F.round(part, 6).alias("daylight"),
    )


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 9 AS a, 1 + o_custkey % 7 AS b FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN a + CAST(1 AS DOUBLE) / b WHEN 1 THEN CAST(a AS DOUBLE) WHEN 2 THEN CAST(a AS DOUBLE) / b END AS miles, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE 'x' END AS blank, 'order ' || o_orderkey || ' of ' || coalesce(CASE WHEN o_custkey % 2 = 0 THEN 'A' END, '') AS note FROM o JOIN orders USING (o_orderkey)""")
def text_values(spark, d):
    k, a, b = F.col("o_orderkey"), (F.col("o_orderkey") % 9).cast("string"), (1 + F.col("o_custkey") % 7).cast("string")
    said = F.when(k % 4 == 0, F.concat(a, F.lit(" 1/"), b)).when(k % 4 == 1, F.concat(F.lit("P"), a, F.lit("SM"))).when(k % 4 == 2, F.concat(a, F.lit("/"), b, F.lit("SM"))).otherwise("none")
    rows = read(spark, d, "orders").withColumn("kind", F.struct(F.when(F.col("o_custkey") % 2 == 0, "A").alias("name")))
    noted = F.rtrim(rules.note("order {o_orderkey}  of {kind.name}"))
    blank = text.blank_to_null(F.when(k % 4 == 3, "  ").otherwise(" x "))
    return rows.select("o_orderkey", text.visibility_sm(said).alias("miles"), blank.alias("blank"), F.when(F.col("kind.name").isNull(), F.concat(noted, F.lit(" "))).otherwise(noted).alias("note"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 30 AS BIGINT) AS h, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey % 3 > 0 END AS usable, CAST(l_suppkey % 40 AS DOUBLE) / 10 AS p, l_partkey % 3 AS air, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey % 3 END AS water,
  ['clear', 'unknown', 'conditional', 'restricted'][CAST(l_partkey % 4 AS INTEGER) + 1] AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT coalesce(usable, false) THEN 'norun' WHEN h <= 8 THEN 'calm' WHEN h <= 12 THEN 'chop' ELSE 'rough' END AS band, p < 2.0 AND h > 6 AS steep, CAST(greatest(air, coalesce(water, 0)) AS INTEGER) AS worse,
  CASE WHEN v = 'restricted' AND l_orderkey % 2 = 0 THEN 'conditional' ELSE v END AS capped FROM l""")
def bands_and_caps(spark, d):
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    usable = F.when(s % 5 != 0, s % 3 > 0)
    rank = lambda r, name: F.struct(r.cast("int").alias("rank"), F.lit(name).alias("limiting"))
    verdict = F.get(F.array(*[F.lit(v) for v in ("clear", "unknown", "conditional", "restricted")]), (k % 4).cast("int"))
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", waves.band(k % 30, usable).alias("band"), waves.steep_chop(k % 30, (s % 40).cast("double") / 10).alias("steep"),
        conditions.worse_of(rank(k % 3, "air"), rank(F.when(s % 4 != 0, s % 3), "water"))["rank"].alias("worse"), rules.capped(verdict, F.col("l_orderkey") % 2 == 0).alias("capped"),
    )


@query("""SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN 'clear' ELSE 'unknown' END AS verdict, CASE WHEN s_suppkey IS NOT NULL THEN 'base,seen ' || s_suppkey ELSE 'base' END AS reasons FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey * 3""")
def verdict_overrides(spark, d):
    v = read(spark, d, "customer").select("c_custkey", F.lit("unknown").alias("verdict"), F.array(F.lit("base")).alias("reasons"))
    o = read(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("c_custkey"), F.lit("clear").alias("verdict"), F.concat(F.lit("seen "), F.col("s_suppkey").cast("string")).alias("reason"))
    return rules.with_overrides(v, o, "c_custkey").select("c_custkey", "verdict", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT o_orderstatus AS verdict, count(*) AS n, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0 GROUP BY 1""")
def verdict_histogram(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderstatus").alias("area"), F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 > 0), "rescinded").when(F.col("o_orderkey") % 3 > 0, "active").alias("status"))
    return matching.active(o).groupBy(F.col("area").alias("verdict")).agg(F.count("*").alias("n"), F.count_if(F.startswith("o_orderpriority", F.lit("1"))).alias("urgent"))
