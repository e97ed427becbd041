"""Queries over stations, fetches that hold for a while, runs and schedules, each over its whole tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import schedule
from tidemark.operators import stations
from tidemark.plans.checks import read
from tidemark.plans.registry import query
from tidemark.streaming import live, stateful

NOW = "2024-01-10 12:00:00"
TZ, TIMES = "America/Detroit", ["06:00", "12:30", "22:00"]


def _now():
    return F.lit(NOW).cast("timestamp")


_RAW = """raw AS (SELECT event_id, ' K' || user_id % 500 || ' ' AS id, CASE WHEN event_id % 5 = 0 THEN '' ELSE '  Some   field ' || user_id % 500 END AS name, 41.60003::DOUBLE + user_id % 500 * 37 % 680 / 100.0::DOUBLE AS lat,
  -90.50003::DOUBLE + user_id % 500 * 53 % 820 / 100.0::DOUBLE AS lon, CASE event_id % 7 WHEN 0 THEN 'VRB' WHEN 1 THEN NULL ELSE CAST(event_id * 13 % 400 AS VARCHAR) END AS wdir,
  CASE WHEN event_id % 7 < 3 AND event_id % 3 = 0 THEN NULL ELSE event_id % 4 * 5.5::DOUBLE END AS wspd, CASE WHEN event_id % 2 = 0 THEN event_id % 30 + 0.4::DOUBLE END AS wgst, ts AS seen FROM events),
s AS (SELECT event_id AS tile, trim(id) AS id, nullif(trim(regexp_replace(name, '\\s+', ' ', 'g')), '') AS name, round(lat, 4) AS lat, round(lon, 4) AS lon,
  CASE WHEN coalesce(round_even(wspd, 0) <> 0, true) THEN CAST(try_cast(wdir AS INTEGER) % 360 AS INTEGER) END AS dir_deg, CAST(round_even(wspd, 0) AS INTEGER) AS speed_kt, CAST(round_even(wgst, 0) AS INTEGER) AS gust_kt, seen AS obs_time FROM raw),
k AS (SELECT * FROM s WHERE speed_kt IS NOT NULL OR dir_deg IS NOT NULL)"""


def _stations(spark, d):
    i, u = F.col("event_id"), F.col("user_id") % 500
    raw = read(spark, d, "events").select(
        i.alias("tile"), F.concat(F.lit(" K"), u, F.lit(" ")).alias("id"), F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("  Some   field "), u)).alias("name"),
        (41.60003 + u * 37 % 680 / 100.0).alias("lat"), (-90.50003 + u * 53 % 820 / 100.0).alias("lon"),
        F.when(i % 7 == 0, "VRB").when(i % 7 > 1, (i * 13 % 400).cast("string")).alias("wdir"), F.when(~((i % 7 < 3) & (i % 3 == 0)), i % 4 * 5.5).alias("wspd"),
        F.when(i % 2 == 0, i % 30 + 0.4).alias("wgst"), F.col("ts").alias("at"),
    )
    return stations.station_rows(raw, "metar", carry=["tile"])


@query(f"WITH {_RAW} SELECT * FROM k")
def station_rows(spark, d):
    return _stations(spark, d).drop("source")


@query(f"""WITH {_RAW}, b AS (SELECT id, arg_max(k, (obs_time, -tile)) AS r FROM k GROUP BY id)
SELECT id, r.name AS name, r.lat AS lat, r.lon AS lon, r.dir_deg AS dir_deg, r.speed_kt AS speed_kt, r.gust_kt AS gust_kt, r.obs_time AS obs_time FROM b
WHERE r.obs_time >= TIMESTAMP '{NOW}' - INTERVAL 3 HOUR AND r.lon BETWEEN -89 AND -84 AND r.lat BETWEEN 42 AND 46""")
def stations_in_box(spark, d):
    return stations.merged(_stations(spark, d), -89.0, 42.0, -84.0, 46.0, _now()).drop("source")


@query("""WITH e AS (SELECT user_id % 100 AS box, event_id AS tile, ts AS fetched_at, CASE event_id % 3 WHEN 0 THEN [] WHEN 1 THEN [event_type || ': timeout'] ELSE ['none: ' || event_id % 4, event_type || ': timeout'] END AS errors FROM events),
x AS (SELECT box, tile, unnest(errors) AS e, generate_subscripts(errors, 1) AS i FROM e), f AS (SELECT box, e, min((tile, i)) AS first FROM x GROUP BY ALL), j AS (SELECT box, string_agg(e, ',' ORDER BY first) AS errors FROM f GROUP BY box)
SELECT box, fetched_at, coalesce(errors, '') AS errors FROM (SELECT box, min(fetched_at) AS fetched_at FROM e GROUP BY box) LEFT JOIN j USING (box)""")
def reply_heads(spark, d):
    i, said = F.col("event_id"), F.concat(F.col("event_type"), F.lit(": timeout"))
    errors = F.when(i % 3 == 0, F.array().cast("array<string>")).when(i % 3 == 1, F.array(said)).otherwise(F.array(F.concat(F.lit("none: "), i % 4), said))
    e = read(spark, d, "events").select((F.col("user_id") % 100).alias("box"), i.alias("tile"), F.col("ts").alias("fetched_at"), errors.alias("errors"))
    return stations.reply_head(e, ["box"]).select("box", "fetched_at", F.array_join("errors", ",").alias("errors"))


@query("""WITH b AS (SELECT c_custkey, -90 + c_custkey % 7 AS w, 40 + c_custkey % 5 AS s, -88.5::DOUBLE + c_custkey % 11 AS e, 42 + c_custkey % 6 AS n FROM customer),
x AS (SELECT *, greatest(0, ceil(e) - floor(w)) * greatest(0, ceil(n) - floor(s)) AS t FROM b)
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'bbox must be west,south,east,north' WHEN c_custkey % 10 = 1 THEN 'bbox must be four numbers' WHEN t > 16 THEN 'bbox too large' END AS error,
  CASE WHEN c_custkey % 10 > 1 THEN CAST(w AS DOUBLE) END AS west, CASE WHEN c_custkey % 10 > 1 THEN CAST(n AS DOUBLE) END AS north FROM x""")
def box_requests(spark, d):
    k = F.col("c_custkey")
    words = F.concat_ws(", ", -90 + k % 7, 40 + k % 5, (-88.5 + k % 11).cast("string"), F.when(k % 10 == 1, "north").when(k % 10 > 1, (42 + k % 6).cast("string")))
    b = read(spark, d, "customer").select("c_custkey", stations.box(words).alias("b"))
    return b.select("c_custkey", "b.error", "b.west", "b.north")


@query("""SELECT c_custkey, round(round_even((41.6::DOUBLE + (c_custkey * 37 % 680) / 100.0::DOUBLE + 0.003) / 0.1::DOUBLE, 0) * 0.1::DOUBLE, 4) AS lat, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey * 7 % 361 AS INTEGER) END AS dir_deg,
  CAST(c_custkey % 4 * 6 AS INTEGER) AS speed_kt, '2024-01-10T12:' || 10 + c_custkey % 40 || ':00Z' AS time FROM customer""")
def point_winds(spark, d):
    k = F.col("c_custkey")
    lat, time = 41.6 + (k * 37 % 680) / 100.0 + 0.003, F.concat(F.lit("2024-01-10T12:"), 10 + k % 40)
    w = stations.point_wind(lat, F.lit(-86.51), k * 7 % 361, k % 4 * 6, F.lit(9.4), time)
    return read(spark, d, "customer").select("c_custkey", w.alias("w")).select("c_custkey", "w.lat", "w.dir_deg", "w.speed_kt", "w.time")


@query(f"""WITH f AS (SELECT user_id AS tile, ts AS fetched_at, event_id AS payload, CASE WHEN event_type = 'click' THEN 'timeout' END AS error FROM events), g AS (SELECT tile, max(fetched_at) AS fetched_at, arg_max(payload, (fetched_at, payload)) AS payload FROM f WHERE error IS NULL GROUP BY tile)
SELECT * FROM g WHERE fetched_at > TIMESTAMP '{NOW}' - INTERVAL 2 DAY""")
def kept_entries(spark, d):
    f = read(spark, d, "events").select(F.col("user_id").alias("tile"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("payload"), F.when(F.col("event_type") == "click", "timeout").alias("error"))
    # Of two fetches at one time the later payload counts, here as in the SQL.
    once = f.where("error IS NULL").groupBy("tile", "fetched_at", "error").agg(F.max("payload").alias("payload"))
    return stations.kept_entries(once, ["tile"], _now(), 2 * 86400).drop("error")


@query()
def ttl_requests(spark, d):
    e = read(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "click").alias("ok"))
    return stations.throttled(e, ["user_id"], "ts", 6 * 3600, ok="ok")


@query()
def fixes_throttled(spark, d):
    e = read(spark, d, "events").select("user_id", "ts", "event_id", (44 + F.col("event_id") % 50 / 1000).alias("lat"), (F.col("event_id") % 30 / 1000 - 86).alias("lon"))
    return stations.throttled(e, ["user_id"], "ts", 3600, least_nm=0.2)


@query()
def ttl_stream(spark, d):
    def make():
        e = live.stream(spark, f"{d}/events.parquet").select("user_id", "ts", "event_id", (F.col("event_type") != "click").alias("ok"))
        return stateful.throttled(e, ["user_id"], "ts", 6 * 3600, ok="ok")

    return stateful.settled(make, spark)


@query("""WITH h AS (SELECT DISTINCT user_id AS slot, CAST(ts AS DATE) AS target_date, CAST(event_id % 24 AS INTEGER) AS at, date_trunc('day', ts) AS generated_at FROM events), t AS (SELECT DISTINCT user_id AS slot, DATE '2024-01-10' + CAST(user_id % 5 AS INTEGER) AS target_date FROM events),
n AS (SELECT slot, target_date, CAST(slot % 24 AS INTEGER) AS at, TIMESTAMP '2024-02-01' AS generated_at FROM t)
SELECT h.* FROM h SEMI JOIN t USING (slot, target_date) ANTI JOIN n ON h.slot = n.slot AND h.at = n.at UNION ALL SELECT * FROM n""")
def carried_runs(spark, d):
    e = read(spark, d, "events")
    history = e.select(F.col("user_id").alias("slot"), F.to_date("ts").alias("target_date"), (F.col("event_id") % 24).cast("int").alias("at"), F.date_trunc("day", "ts").alias("generated_at")).distinct()
    targets = e.select(F.col("user_id").alias("slot"), F.date_add(F.lit("2024-01-10").cast("date"), (F.col("user_id") % 5).cast("int")).alias("target_date")).distinct()
    new = targets.select("slot", "target_date", (F.col("slot") % 24).cast("int").alias("at"), F.lit("2024-02-01").cast("timestamp").alias("generated_at"))
    return stations.carried_runs(history, targets, new, ["slot"])


@query("""WITH a AS (SELECT event_id, user_id, ['06:00', '07:15', '22:00', '23:00'][event_id % 4 + 1] AS run_at, CAST(ts AS DATE) AS target_date, ts AS now FROM events),
s AS (SELECT DISTINCT user_id, CAST(timezone('America/Detroit', timezone('UTC', ts)) AS DATE) AS day FROM events WHERE event_type = 'view')
SELECT event_id, coalesce(run_at IN ('06:00', '12:30', '22:00'), false) OR (target_date = CAST(timezone('America/Detroit', timezone('UTC', now)) AS DATE) AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = a.user_id AND s.day = CAST(timezone('America/Detroit', timezone('UTC', now)) AS DATE))) AS record FROM a""")
def runs_to_record(spark, d):
    e = read(spark, d, "events")
    run_at = F.get(F.array(*map(F.lit, ["06:00", "07:15", "22:00", "23:00"])), (F.col("event_id") % 4).cast("int"))
    asks = e.select("event_id", "user_id", run_at.alias("run_at"), F.to_date("ts").alias("target_date"), F.col("ts").alias("now"))
    history = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("generated_at"))
    return stations.to_record(asks, history, ["user_id"], TIMES, TZ).select("event_id", "record")


@query("""WITH a AS (SELECT event_id, ts + INTERVAL 59 DAY AS now, CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 59 DAY - INTERVAL 40 MINUTE END AS last_run FROM events),
w AS (SELECT event_id, now, last_run, timezone('UTC', timezone('America/Detroit', CAST(CAST(timezone('America/Detroit', timezone('UTC', now)) AS DATE) + o AS TIMESTAMP) + to_minutes(m))) AS "at" FROM a, unnest([-1, 0, 1]) AS u(o), unnest([360, 750, 1320]) AS v(m))
SELECT event_id, "at" FROM w WHERE "at" <= now AND "at" >= now - INTERVAL 90 MINUTE AND (last_run IS NULL OR "at" > last_run)""")
def due_times(spark, d):
    now = F.col("ts") + F.expr("interval 59 days")
    last = F.when(F.col("event_id") % 3 > 0, now - F.expr("interval 40 minutes"))
    return read(spark, d, "events").select("event_id", F.explode(schedule.due(now, last, TIMES, TZ)).alias("at"))


@query("""WITH a AS (SELECT event_id, ts, strftime(ts, '%H:%M') AS hm, CAST(ts AS DATE) AS day FROM events)
SELECT event_id, CASE WHEN hm < '06:00' THEN '06:00' WHEN hm < '12:30' THEN '12:30' WHEN hm < '22:00' THEN '22:00' ELSE '06:00' END AS following, event_id % 4 = 0 OR event_id % 300 > 180 AS stale,
  CASE WHEN event_id % 3 = 0 THEN day + INTERVAL 0 HOUR WHEN event_id % 3 = 1 THEN day + INTERVAL 7 HOUR ELSE day + INTERVAL 9 HOUR END AS start, day + INTERVAL 10 HOUR AS "end" FROM a""")
def schedule_values(spark, d):
    i, ts = F.col("event_id"), F.col("ts")
    made = F.when(i % 4 > 0, (ts - F.make_interval(mins=(i % 300).cast("int"))).cast("string"))
    day = F.to_date(ts)
    rises = F.when(i % 3 == 1, F.timestamp_add("HOUR", F.lit(7), F.date_trunc("day", ts))).when(i % 3 == 2, F.timestamp_add("HOUR", F.lit(11), F.date_trunc("day", ts)))
    m = schedule.morning(day, rises, F.lit(None).cast("timestamp"), "sunrise", "10:00")
    return read(spark, d, "events").select("event_id", schedule.following(ts, TIMES).alias("following"), schedule.stale(ts, made).alias("stale"), m["start"].alias("start"), m["end"].alias("end"))


@query("""WITH h AS (SELECT user_id, date_trunc('hour', ts) AS h, max(CASE WHEN event_id % 5 > 0 THEN event_id % 361 END) AS dir, max(value) AS kt FROM events GROUP BY ALL), s AS (SELECT u AS user_id, x AS h FROM (SELECT DISTINCT user_id AS u FROM events), unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-11', INTERVAL 1 HOUR)) AS g(x))
SELECT user_id, string_agg(coalesce(CAST(CAST(dir AS INTEGER) AS VARCHAR), '-'), ',' ORDER BY s.h) AS dirs, string_agg(CASE WHEN dir IS NULL OR kt IS NULL THEN '-' ELSE 'm' END, '' ORDER BY s.h) AS models FROM s LEFT JOIN h USING (user_id, h) GROUP BY user_id""")
def aligned_winds(spark, d):
    e = read(spark, d, "events").withColumn("h", F.date_trunc("hour", "ts"))
    series = e.groupBy("user_id", "h").agg(F.max(F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 361)).alias("dir_deg"), F.max("value").alias("speed_kt")).withColumns({"gust_kt": F.col("speed_kt") + 3, "model": F.lit("m")})
    hours = F.sequence(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-11").cast("timestamp"), F.expr("interval 1 hour"))
    spine = e.select("user_id").distinct().select("user_id", F.explode(hours).alias("h"))
    said = lambda c, none: F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(none)))
    out = stations.aligned(spine, series, ["user_id"], "h")
    return out.select("user_id", F.array_join(said(F.col("dir_deg"), "-"), ",").alias("dirs"), F.array_join(said(F.col("model"), "-"), "").alias("models"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'K' || s_suppkey ELSE 'F' || s_suppkey END AS id, 'Some Field' AS name, CAST(round_even(s_suppkey % 400 * 3.28084::DOUBLE, 0) AS INTEGER) AS elev_ft, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '9/27:' || s_suppkey % 360 || ':' || 3000 + s_suppkey || ',' END || 'N:0:-' AS runways FROM supplier""")
def home_airports(spark, d):
    k = F.col("s_suppkey")
    runway = lambda name, a, dim: F.struct(F.lit(name).alias("id"), a.cast("double").alias("alignment"), dim.alias("dimension"))
    raw = read(spark, d, "supplier").select(
        F.when(k % 2 == 0, F.concat(F.lit("K"), k)).otherwise("").alias("icaoId"), F.concat(F.lit("F"), k).alias("faaId"), F.lit(None).cast("string").alias("iataId"), F.lit(" SOME  field").alias("name"),
        F.lit(44.0).alias("lat"), F.lit(-86.0).alias("lon"), (k % 400).alias("elev"), F.array(runway(" 9/27", F.when(k % 3 > 0, k % 360), F.concat(3000 + k, F.lit("x150"))), runway("N", F.lit(360), F.lit("long"))).alias("runways"), k.alias("s_suppkey"),
    )
    told = F.transform("runways", lambda r: F.concat_ws(":", r["id"], r["heading"].cast("string"), F.coalesce(r["length_ft"].cast("string"), F.lit("-"))))
    return stations.home_airport(raw, carry=["s_suppkey"]).select("s_suppkey", "id", "name", "elev_ft", F.array_join(told, ",").alias("runways"))


@query("""WITH f AS (SELECT l_suppkey AS lake, l_partkey % 20 AS cell, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem GROUP BY ALL)
SELECT lake, cell, row_number() OVER (PARTITION BY lake ORDER BY o, cell) AS place FROM f""")
def cells_first_seen(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("lake"), (F.col("l_partkey") % 20).alias("cell"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return stations.first_seen(rows, ["lake", "cell"], "o").withColumn("place", F.col("place").cast("long"))


@query("""SELECT event_type AS source, count(*) AS n FROM events WHERE event_type <> 'click' AND event_type IN ('click', 'view') GROUP BY 1""")
def feeds_gathered(spark, d):
    e = read(spark, d, "events")
    feeds = {t: e.where(F.col("event_type") == t) for t in ("click", "view")}
    failures = e.where("event_type = 'click'").select(F.col("event_type").alias("source"), F.lit("timeout").alias("error"))
    return stations.gathered(feeds, failures).groupBy("source").agg(F.count("*").alias("n"))
