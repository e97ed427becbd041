"""Queries over headers, labels and briefings, each over its whole tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import headers, labels
from tidemark.operators import briefing
from tidemark.plans.checks import read
from tidemark.plans.registry import query

#: A header for each part: its name in one of many frames.
FRAMES = ["{} LAKE", "{} River, East Branch", "{} Lake - North Township", "{} Bay near Point", "{} CREEK LAKE (canals)", "Lake", "{} Harbor of Refuge", "{} River and Tributaries", "THE {} OF THE O'BRIEN pond", "{} Basin"]
_FRAMED = "replace(list_value({})[CAST(p_partkey % 10 AS INTEGER) + 1], '{{}}', p_name)".format(", ".join("'" + f.replace("'", "''") + "'" for f in FRAMES))


def framed(spark, d):
    return read(spark, d, "part").select("p_partkey", F.replace(F.get(F.array(*[F.lit(f) for f in FRAMES]), (F.col("p_partkey") % 10).cast("int")), F.lit("{}"), F.col("p_name")).alias("raw"))


_HEAD = rf"trim(regexp_replace(raw, '{headers.SUFFIX}', ''))"
_PLAIN = rf"regexp_replace({_HEAD}, '\s*\([^)]*\)\s*', ' ', 'g')"


@query(rf"""WITH h AS (SELECT p_partkey, {_FRAMED} AS raw FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(trim({_PLAIN}), '{headers.LAKE_ENDING}') THEN 'lake' WHEN regexp_matches({_HEAD}, '{headers.WATERWAY}') THEN 'waterway' ELSE 'lake' END AS kind,
  regexp_matches(trim(regexp_replace({_PLAIN}, '{headers.TRAILING_CLAUSE}', '')), '{headers.BAY_ENDING}') AS bay FROM h""")
def header_kinds(spark, d):
    return framed(spark, d).select("p_partkey", headers.kind(F.col("raw")).alias("kind"), headers.is_bay_or_harbor(F.col("raw")).alias("bay"))


@query(rf"""WITH h AS (SELECT p_partkey, {_FRAMED} AS raw FROM part), t AS (SELECT p_partkey, unnest(regexp_extract_all(raw, '[A-Za-z][A-Za-z'']*|[^A-Za-z]+')) AS t, generate_subscripts(regexp_extract_all(raw, '[A-Za-z][A-Za-z'']*|[^A-Za-z]+'), 1) AS i FROM h)
SELECT p_partkey, string_agg(CASE WHEN NOT regexp_matches(t, '^[A-Za-z]') OR (length(t) > 1 AND t <> upper(t)) THEN t WHEN i > 1 AND lower(t) IN ('and','of','the','to','in','at','on','for','a','an','or') THEN lower(t)
  ELSE upper(t[1]) || lower(t[2:]) END, '' ORDER BY i) AS title FROM t GROUP BY 1""")
def title_case(spark, d):
    return framed(spark, d).select("p_partkey", headers.title_case(F.col("raw")).alias("title"))


@query("""WITH a AS (SELECT c_custkey, c_mktsegment || ' Twp., ' || upper(c_mktsegment) || ' twp , St. ' || c_name || ',' AS v FROM customer)
SELECT c_custkey, array_to_string(list_distinct_ordered, '|') AS keys FROM (SELECT c_custkey, [regexp_replace(lower(split_part(v, ' Twp.', 1)), '[^a-z0-9]+', ' ', 'g') || ' township', trim(regexp_replace(lower('St. ' || c_name), '[^a-z0-9]+', ' ', 'g'))] AS list_distinct_ordered FROM a JOIN customer USING (c_custkey))""")
def area_keys(spark, d):
    seg = F.col("c_mktsegment")
    v = F.concat(seg, F.lit(" Twp., "), F.upper(seg), F.lit(" twp , St. "), F.col("c_name"), F.lit(","))
    return read(spark, d, "customer").select("c_custkey", F.array_join(headers.area_keys(v), "|").alias("keys"))


@query("""SELECT o_orderkey, 'R 281.' || o_orderkey % 900 || '.' || o_custkey || ',R 281.' || o_orderkey % 900 || '.' || o_custkey || ',WC-' || o_orderkey % 99 || '-' || o_custkey % 99 || '-' || o_orderkey % 999 AS ids,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Saturdays, Sundays and holidays' WHEN o_orderkey % 3 = 1 THEN 'Sundays' END AS days, 'T' || o_orderkey % 90 || 'S R' || o_custkey % 30 || 'W' AS flipped, split_part('History Publisher''s clause signage', ' ', 1 + CAST(o_orderkey % 4 AS INTEGER)) AS word,
  CASE o_orderkey % 4 WHEN 0 THEN 'history' WHEN 1 THEN 'publisher' WHEN 2 THEN 'clause' ELSE 'signage' END AS kind FROM orders""")
def rule_text_fields(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    r = F.concat(F.lit("R 281."), s(k % 900), F.lit("."), s(c))
    ids = F.concat(F.lit("Under "), r, F.lit(" and WC "), s(k % 99), F.lit(" - "), s(c % 99), F.lit("-"), s(k % 999), F.lit(", see "), r)
    days = F.when(k % 3 == 0, "on Sundays or on Saturdays,  Sundays and holidays, and from noon").when(k % 3 == 1, "Memorial Day; Sundays, and").otherwise("on Labor Day")
    word = F.get(F.array(*[F.lit(w) for w in ("History", "Publisher's", "clause", "signage")]), (k % 4).cast("int"))
    paragraph = F.when(k % 4 == 1, "Publisher's Note: x").when(k % 4 == 3, "must be marked with signs").otherwise(F.concat(word, F.lit(" 1989")))
    flipped = headers.flipped(F.concat(F.lit("T"), s(k % 90), F.lit("N R"), s(c % 30), F.lit("E")))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(headers.rule_ids(ids), ",").alias("ids"), headers.days(days).alias("days"), flipped.alias("flipped"), word.alias("word"), headers.paragraph_kind(paragraph).alias("kind"))


@query("""WITH w AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id * 7 % 720 / 2.0 END AS deg, round(value, 0) AS kt, value * 1.3 AS gust, event_id % 3000 / 1.0 AS m FROM events),
r AS (SELECT *, CAST(floor(kt + 0.5) AS BIGINT) AS k, CAST(floor(gust + 0.5) AS BIGINT) AS g, CAST(floor(deg + 0.5) AS BIGINT) % 360 AS n, CAST(floor(m + 0.5) AS BIGINT) AS mm FROM w)
SELECT event_id, CASE WHEN k = 0 THEN 'calm' ELSE coalesce(lpad(CAST(CASE WHEN n = 0 THEN 360 ELSE n END AS VARCHAR), 3, '0'), 'VRB') || '/' || k || CASE WHEN g > k THEN ' G' || g ELSE '' END END AS wind,
  k || CASE WHEN g > k THEN 'G' || g ELSE '' END AS speed, CASE WHEN mm < 1 THEN 'just now' WHEN mm < 60 THEN mm || ' min ago' WHEN mm % 60 = 0 THEN mm // 60 || ' h ago' ELSE mm // 60 || ' h ' || mm % 60 || ' min ago' END AS ago,
  CASE WHEN m / 100 < 10 THEN printf('%.1f', CASE WHEN (m / 50) % 1 = 0.5 THEN m / 100 + 1e-9 ELSE m / 100 END) ELSE CAST(floor(m / 100 + 0.5) AS BIGINT)::VARCHAR END || ' nm' AS nm FROM r""")
def wind_labels(spark, d):
    e, i = read(spark, d, "events"), F.col("event_id")
    deg, kt, gust, m = F.when(i % 11 != 0, i * 7 % 720 / 2.0), F.round("value", 0), F.col("value") * 1.3, (i % 3000).cast("double")
    return e.select("event_id", labels.wind(deg, kt, gust).alias("wind"), labels.speed(kt, gust).alias("speed"), labels.ago(m).alias("ago"), labels.distance(m / 100).alias("nm"))


@query("""SELECT s_suppkey, greatest(s_suppkey % 30, s_suppkey % 7) * 0.868976::DOUBLE AS top_kt, s_suppkey % 16 * 22.5::DOUBLE AS deg, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey * 10 END AS length_ft,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE least(s_suppkey * 10.0, 4000.0)::DOUBLE END AS ceiling, s_suppkey % 6 = 0 AS fog FROM supplier""")
def feed_texts(spark, d):
    k = F.col("s_suppkey")
    s = lambda x: x.cast("string")
    compass = F.get(F.array(*[F.lit(c) for c in labels.COMPASS]), (k % 16).cast("int"))
    dims = F.when(k % 5 == 0, F.concat(s(k), F.lit(" by 75"))).otherwise(F.concat(s(k * 10), F.lit("x150")))
    layer = lambda cover, base: F.struct(F.lit(cover).alias("cover"), base.alias("base"))
    clouds = F.when(k % 4 == 0, F.array(layer("FEW", k * 1.0))).otherwise(F.array(layer("SCT", k * 1.0), layer("BKN", F.lit(4000.0)), layer("OVC", k * 10.0)))
    return read(spark, d, "supplier").select(
        "s_suppkey", labels.range_top_kt(F.concat(s(k % 30), F.lit(" to "), s(k % 7), F.lit(" mph"))).alias("top_kt"), labels.compass_deg(F.lower(compass)).alias("deg"), labels.length_ft(dims).alias("length_ft"),
        labels.ceiling_ft(clouds, F.lit(None)).alias("ceiling"), labels.has_fog(F.when(k % 6 == 0, "-RA BCFG").otherwise("RA")).alias("fog"),
    )


#: An hour on a water for each line item: waves, run, wind and chord out of its numbers.
_HOURS = """SELECT l_orderkey, l_linenumber, l_partkey % 200 AS water, l_quantity % 20 AS hs_in, l_extendedprice % 5000 AS run_ft, l_suppkey % 25 AS wind_kt, l_partkey * 7 % 360 AS wind_dir, l_suppkey * 50 % 4000 AS chord_ft, l_orderkey * 11 % 180 AS bearing, l_linenumber % 2 = 0 AS has_field FROM lineitem"""
_SCORED = f"""WITH h AS ({_HOURS}), x AS (SELECT *, CASE WHEN wind_kt >= 3 THEN abs(wind_kt * sin(radians(CAST(wind_dir - bearing AS DOUBLE)))) END AS xw FROM h),
f AS (SELECT *, CASE WHEN hs_in <= 8 THEN 0 WHEN hs_in <= 12 THEN 1 ELSE 2 END AS waves, CASE WHEN run_ft >= 2000 THEN 0 WHEN NOT has_field AND chord_ft >= 2000 AND (xw IS NULL OR xw <= 10) THEN 1 ELSE 2 END AS run FROM x),
s AS (SELECT *, greatest(waves, run) AS level, CASE WHEN greatest(waves, run) = 0 THEN NULL WHEN waves >= run THEN 'waves' WHEN run = 1 THEN 'xwind_water' ELSE 'run' END AS limiting FROM f)"""


def water_hours(spark, d):
    i = read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 200).alias("water"), (F.col("l_quantity") % 20).alias("hs_in"), (F.col("l_extendedprice") % 5000).alias("run_ft"), (F.col("l_suppkey") % 25).alias("wind_kt"),
        (F.col("l_partkey") * 7 % 360).alias("wind_dir"), (F.col("l_suppkey") * 50 % 4000).alias("chord_ft"), (F.col("l_orderkey") * 11 % 180).alias("chord_bearing"), (F.col("l_linenumber") % 2 == 0).alias("has_field"),
    )
    return briefing.water_hour(i)


@query(f"{_SCORED} SELECT l_orderkey, l_linenumber, round(xw, 6) AS xwind_kt, level, limiting FROM s")
def water_hour_score(spark, d):
    return water_hours(spark, d).select("l_orderkey", "l_linenumber", F.round("xwind_kt", 6).alias("xwind_kt"), "level", "limiting")


@query(f"""{_SCORED}, w AS (SELECT water, max(level) AS level, max(hs_in) AS hs_in, min(run_ft) AS run_ft, min(l_linenumber + water) * 1.5 AS nm FROM s GROUP BY water)
SELECT water, CAST(CASE WHEN water % 50 = 7 THEN 2 ELSE level END AS INTEGER) AS level, hs_in, round(run_ft, 4) AS run_ft, round(nm, 4)::DOUBLE AS nm, water % 50 = 7 AS frozen FROM w ORDER BY CASE WHEN water % 50 = 7 THEN 2 ELSE level END, nm, hs_in, water LIMIT 40""")
def rank_waters(spark, d):
    h = water_hours(spark, d).withColumn("distance_nm", (F.col("l_linenumber") + F.col("water")) * 1.5)
    out = briefing.ranked(h, ["water"], 40, F.col("water") % 50 == 7)
    return out.select("water", "level", "hs_in", F.round("run_ft", 4).alias("run_ft"), F.round("distance_nm", 4).alias("nm"), "frozen")


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS covers, o_orderkey % 10 <> 1 AS any_cover, o_custkey % 3 > 0 AS agrees, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 12 END AS diff, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderkey % 3 END AS move FROM orders)
SELECT o_orderkey, CASE WHEN diff > 8 OR move >= 2 THEN 'low' WHEN covers AND agrees AND diff <= 4 AND move = 0 THEN 'high' ELSE 'medium' END AS confidence,
CASE WHEN diff > 8 THEN 'NWS and model wind differ by ' || diff || ' kt' WHEN move >= 2 THEN 'the outlook moved two levels since the last run' WHEN covers AND agrees AND diff <= 4 AND move = 0 THEN 'TAF covers the window and agrees with the model'
ELSE concat_ws('; ', CASE WHEN NOT any_cover THEN 'no TAF coverage for the window' WHEN covers AND NOT agrees THEN 'TAF and model disagree on ceiling or visibility' END,
  CASE WHEN diff IS NULL THEN 'no NWS wind to compare' WHEN diff > 4 THEN 'NWS and model wind differ by ' || diff || ' kt' END, CASE WHEN move IS NULL THEN 'first run for this morning' WHEN move = 1 THEN 'the outlook moved a level since the last run' END) END AS reasons FROM r""")
def confidence_reasons(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    r = read(spark, d, "orders").select("o_orderkey", (k % 2 == 0).alias("covers"), (k % 10 != 1).alias("any_cover"), (c % 3 > 0).alias("agrees"), F.when(k % 7 != 0, (c % 12).cast("double")).alias("wind_diff"), F.when(c % 5 != 0, (k % 3).cast("int")).alias("move"))
    return briefing.with_confidence(r).select("o_orderkey", "confidence", F.array_join("reasons", "; ").alias("reasons"))


_HOURLY = "h AS (SELECT user_id AS k, date_trunc('hour', ts) AS h, CAST(max(event_id) % 3 AS INTEGER) AS level, max(value) AS v, min(event_id) AS e FROM events GROUP BY ALL)"


def hourly(spark, d):
    return read(spark, d, "events").groupBy(F.col("user_id").alias("k"), F.date_trunc("hour", "ts").alias("h")).agg((F.max("event_id") % 3).cast("int").alias("level"), F.max("value").alias("v"), F.min("event_id").alias("e"))


@query(f"""WITH {_HOURLY}, a AS (SELECT k, arg_min(level, h) = 2 AS first, min(h) FILTER (WHERE level < 2) AS clear, max(h) AS last, max(v) FILTER (WHERE h >= TIMESTAMP '2024-01-05' AND h < TIMESTAMP '2024-01-20') AS peak,
  arg_max(e, (level, -epoch_us(h))) FILTER (WHERE h >= TIMESTAMP '2024-01-05' AND h < TIMESTAMP '2024-01-20') AS worst FROM h GROUP BY k)
SELECT k, CASE WHEN first THEN epoch(coalesce(clear, last))::BIGINT END AS clears, peak, worst FROM a""")
def window_values(spark, d):
    h, low, high = hourly(spark, d), F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    clear = briefing.clears_at(h.withColumn("bad", F.col("level") == 2), ["k"], "h", "bad")
    worst = briefing.worst_in(h.withColumn("low", low).withColumn("high", high), ["k"], "h", "low", "high", "e")
    out = clear.join(briefing.peak_in(h, ["k"], "h", "v", low, high), "k").join(worst.select("k", F.col("e").alias("worst")), "k", "left")
    return out.select("k", F.unix_seconds("clears_at").alias("clears"), "peak", "worst")


@query(f"""WITH {_HOURLY}, b AS (SELECT k, CAST(h AS DATE) AS day, min(level) AS best, count(*) AS n FROM h GROUP BY ALL),
g AS (SELECT k, day, h, best, h - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY k, day ORDER BY h) AS island FROM (SELECT h.*, b.day, b.best FROM h JOIN b ON h.k = b.k AND CAST(h.h AS DATE) = b.day) WHERE level <= best),
r AS (SELECT k, day, min(h) AS s, max(h) + INTERVAL 1 HOUR AS e, count(*) AS n FROM g GROUP BY k, day, island),
t AS (SELECT k, day, arg_max(s, (n, -epoch(s))) AS s, arg_max(e, (n, -epoch(s))) AS e FROM r GROUP BY k, day)
SELECT k, CAST(day AS VARCHAR) AS day, best AS level, b.n AS n, hour(s) AS since, epoch(CASE WHEN e > day + INTERVAL 20 HOUR AND s < day + INTERVAL 20 HOUR THEN day + INTERVAL 20 HOUR ELSE e END)::BIGINT AS until FROM b JOIN t USING (k, day)""")
def day_rollup(spark, d):
    dusk = F.col("day").cast("timestamp") + F.expr("interval 20 hours")
    out = briefing.day_blocks(hourly(spark, d), ["k"], "h", "h", dusk)
    return out.select("k", F.col("day").cast("string").alias("day"), "level", F.size("blocks").cast("long").alias("n"), F.hour("from").cast("long").alias("since"), F.unix_seconds("until").alias("until"))


_PERIODS = """p AS (SELECT event_id AS ord, user_id AS k, ts AS s, ts + INTERVAL 1 HOUR * (1 + event_id % 30) AS e, event_id % 3 = 0 AS o, value AS c, value * 2 AS g FROM events)"""


@query(f"""WITH {_HOURLY}, {_PERIODS}, m AS (SELECT h.k, h.h, p.* EXCLUDE (k) FROM h JOIN p ON h.k = p.k AND h.h + INTERVAL 30 MINUTE >= p.s AND h.h + INTERVAL 30 MINUTE < p.e),
a AS (SELECT k, h, coalesce(arg_max(c, ord) FILTER (WHERE NOT o), arg_min(c, ord)) AS c, coalesce(arg_max(g, ord) FILTER (WHERE NOT o), arg_min(g, ord)) AS g, min(c) FILTER (WHERE o) AS oc, max(g) FILTER (WHERE o) AS og FROM m GROUP BY k, h)
SELECT k, epoch(h)::BIGINT AS h, least(c, oc) AS ceiling, greatest(g, og) AS gust FROM a""")
def interval_join(spark, d):
    """Each hour of a user with the periods that cover it at half past: the last prevailing one, made worse by overlays. All events are periods."""
    e = read(spark, d, "events")
    p = e.select(F.col("user_id").alias("k"), F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(hours=(1 + F.col("event_id") % 30).cast("int"))).alias("end"), F.col("event_id").alias("ord"), (F.col("event_id") % 3 == 0).alias("overlay"), F.col("value").alias("ceiling"), (F.col("value") * 2).alias("gust"))
    out = briefing.sampled_periods(hourly(spark, d), p, ["k"], "h", {"ceiling": "min", "gust": "max"})
    return out.select("k", F.unix_seconds("h").alias("h"), "ceiling", "gust")


@query(f"""WITH {_HOURLY}, l AS (SELECT DISTINCT user_id AS k, event_type AS t FROM events), c AS (SELECT user_id AS k, date_trunc('hour', ts) AS h, event_type AS t, count(*) AS n FROM events GROUP BY ALL)
SELECT h.k, epoch(h.h)::BIGINT AS h, string_agg(coalesce(CAST(n AS VARCHAR), '-'), ',' ORDER BY l.t) AS cells FROM h JOIN l ON h.k = l.k LEFT JOIN c ON c.k = h.k AND c.h = h.h AND c.t = l.t GROUP BY h.k, h.h""")
def hour_label_matrix(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("k"), F.date_trunc("hour", "ts").alias("h"), F.col("event_type").alias("t"))
    cells = e.groupBy("k", "h", "t").agg(F.count("*").alias("n"))
    out = briefing.matrix(hourly(spark, d), e, cells, ["k"], "h", "t", "n")
    return out.select("k", F.unix_seconds("h").alias("h"), F.array_join(F.transform("cells", lambda x: x.cast("string")), ",", "-").alias("cells"))


@query("""WITH f AS (SELECT user_id AS k, event_type AS s, max(ts) AS t FROM events GROUP BY ALL) SELECT k, epoch_us(min(t)) AS oldest, string_agg(s || '=' || epoch_us(t), ',' ORDER BY s) AS sources FROM f GROUP BY k""")
def feed_freshness(spark, d):
    out = briefing.freshness(read(spark, d, "events").withColumnRenamed("user_id", "k"), ["k"], "event_type", "ts")
    said = F.array_join(F.transform(F.array_sort(F.map_entries("sources")), lambda x: F.concat(x["key"], F.lit("="), F.unix_micros(x["value"]).cast("string"))), ",")
    return out.select("k", F.unix_micros("oldest").alias("oldest"), said.alias("sources"))


@query("""WITH w AS (SELECT o_orderkey, o_orderdate + INTERVAL 1 MINUTE * (o_orderkey % 97) AS s, o_orderdate + INTERVAL 1 MINUTE * (o_orderkey % 97 + o_custkey % 600) AS e, o_orderdate + INTERVAL 1 MINUTE * (o_custkey % 240) AS now FROM orders),
h AS (SELECT o_orderkey, now, unnest(generate_series(date_trunc('hour', s), e, INTERVAL 1 HOUR)) AS h, e FROM w WHERE s < e)
SELECT o_orderkey, count(h.h) AS n, epoch(min(h.h))::BIGINT AS first FROM w LEFT JOIN (SELECT o_orderkey, h FROM h WHERE h < e AND h + INTERVAL 1 HOUR > now) h USING (o_orderkey) GROUP BY 1""")
def window_hours(spark, d):
    at = lambda m: F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=m.cast("int"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    hours = briefing.whole_hours(at(k % 97), at(k % 97 + c % 600), at(c % 240))
    return read(spark, d, "orders").select("o_orderkey", hours.alias("h")).select("o_orderkey", F.size("h").cast("long").alias("n"), F.unix_seconds(F.get("h", F.lit(0))).alias("first"))


@query(f"""WITH {_HOURLY}, w AS (SELECT k, h AS s, h + INTERVAL 1 HOUR AS e, level FROM h WHERE level < 2), n AS (SELECT TIMESTAMP '2024-01-15 06:30:00' AS now),
a AS (SELECT k, arg_min(level, s) AS level, min(s) AS s FROM w, n WHERE e > now GROUP BY k), b AS (SELECT k, min(level) AS level, arg_min(h, (level, h)) AS s FROM h, n WHERE h + INTERVAL 1 HOUR > now GROUP BY k)
SELECT k, CASE WHEN a.s IS NOT NULL THEN 'window' ELSE 'best' END AS kind, coalesce(a.level, b.level) AS level, epoch(coalesce(a.s, b.s))::BIGINT AS start FROM a FULL JOIN b USING (k)""")
def lead_line(spark, d):
    h = hourly(spark, d).withColumnRenamed("h", "hour")
    w = h.where("level < 2").select("k", F.col("hour").alias("start"), (F.col("hour") + F.expr("interval 1 hour")).alias("end"), F.col("level").alias("score"))
    return briefing.lead(w, h, ["k"], F.lit("2024-01-15 06:30:00").cast("timestamp")).select("k", "kind", "level", F.unix_seconds("start").alias("start"))
