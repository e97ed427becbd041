"""Queries over headers and bodies of rule entries, one for each row of whole tables; SQL builds what each frame must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clauses, zones
from tidemark.plans.checks import read
from tidemark.plans.registry import query
from tidemark.sources import nodes
from tidemark.storage import spread

HEADERS = [
    "ALDER{} AND BIRCH LAKES", "BIG AND LITTLE ALDER{} LAKES", "STONE LAKES (TAN, ALDER{}, AND LONG)", "ALDER{} LAKE, NORTH BASIN", "ALDER{} RIVER FROM OAK CREEK TO BLACK LAKE",
    "FISH LAKE AND ALDER{} LAKE; CHANNELS AND CANALS", "CANAL CONNECTED TO ALDER{} LAKE",
]
BODIES = [
    "Rule 7. On the waters of Alder{} township, city of Alma, no operator shall:\n(a) Operate a vessel at high speed.\n(b) Have in tow a person on water skis.",
    "Boats in the township of Alder{} shall: (a) keep to: (i) ten, (ii) twenty.\n(b) Stay below 10.5 miles per hour.\n(c) Operate at slow-no wake speed between 7:30 p.m. and 10:00 a.m. during June and July.",
    "No vessel shall operate near island {}.",
    "By order:\n1. Motorboats are prohibited above 15 miles per hour by Alder{}.\n2. Water sleds of the village of Elk and village of Elk only.",
]


def _framed(spark, d, frames):
    k = F.col("p_partkey")
    frame = F.get(F.array(*[F.lit(f) for f in frames]), (k % len(frames)).cast("int"))
    return spread(read(spark, d, "part").select("p_partkey")).select(k.alias("id"), F.replace(frame, F.lit("{}"), k.cast("string")).alias("t"))


@query("""WITH p AS (SELECT p_partkey AS id, 'Alder' || p_partkey AS a FROM part)
SELECT id, CASE id % 7 WHEN 0 THEN a || ' Lake|Birch Lake' WHEN 1 THEN 'Big ' || a || ' Lake|Little ' || a || ' Lake' WHEN 2 THEN 'Tan Lake|' || a || ' Lake|Long Lake' WHEN 4 THEN a || ' River' WHEN 5 THEN 'Fish Lake|' || a || ' Lake' ELSE a || ' Lake' END AS waters,
  CASE id % 7 WHEN 3 THEN 'North Basin' WHEN 5 THEN 'Channels and Canals' ELSE '' END AS parts FROM p""")
def header_waters(spark, d):
    return _framed(spark, d, HEADERS).select("id", F.array_join(clauses.water_names(F.col("t")), "|").alias("waters"), F.array_join(clauses.part_segments(F.col("t")), "|").alias("parts"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Alder' || p_partkey || ' Township, City of Alma' WHEN 1 THEN 'Alder' || p_partkey || ' Township' WHEN 3 THEN 'Village of Elk' END AS places FROM part""")
def townships_named(spark, d):
    return _framed(spark, d, BODIES).select("id", clauses.townships(F.col("t")).alias("places"))


@query("""WITH p AS (SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS k FROM part), c AS (
SELECT id, unnest(CASE id % 4 WHEN 0 THEN ['(a)', '(b)'] WHEN 1 THEN ['(a)', '(b)', '(c)'] WHEN 2 THEN [NULL] ELSE ['(1)', '(2)'] END) AS label, unnest(CASE id % 4
  WHEN 0 THEN ['Operate a vessel at high speed.', 'Have in tow a person on water skis.']
  WHEN 1 THEN ['keep to: (i) ten, (ii) twenty.', 'Stay below 10.5 miles per hour.', 'Operate at slow-no wake speed between 7:30 p.m. and 10:00 a.m. during June and July.']
  WHEN 2 THEN ['No vessel shall operate near island ' || k || '.']
  ELSE ['Motorboats are prohibited above 15 miles per hour by Alder' || k || '.', 'Water sleds of the village of Elk and village of Elk only.'] END) AS text FROM p) SELECT * FROM c""")
def clause_rows(spark, d):
    return clauses.split(_framed(spark, d, BODIES), "t").select("id", "label", "text")


@query("""WITH p AS (SELECT p_partkey AS id, 'Alder' || p_partkey AS a FROM part), n AS (SELECT id, unnest(CASE id % 7 WHEN 0 THEN [a || ' Lake', 'Birch Lake'] WHEN 1 THEN ['Big ' || a || ' Lake', 'Little ' || a || ' Lake'] WHEN 2 THEN ['Tan Lake', a || ' Lake', 'Long Lake']
  WHEN 4 THEN [a || ' River'] WHEN 5 THEN ['Fish Lake', a || ' Lake'] ELSE [a || ' Lake'] END) AS name FROM p),
r AS (SELECT id, unnest(CASE id % 4 WHEN 0 THEN [{'kind': 'no_high_speed', 'clause': NULL, 'start': NULL, 'ss': NULL, 'mph': NULL}]
  WHEN 1 THEN [{'kind': 'other', 'clause': '(a)', 'start': NULL, 'ss': NULL, 'mph': NULL}, {'kind': 'speed_limit', 'clause': '(b)', 'start': NULL, 'ss': NULL, 'mph': 10.5}, {'kind': 'slow_no_wake', 'clause': '(c)', 'start': '19:30', 'ss': '06-01', 'mph': NULL}]
  WHEN 2 THEN [{'kind': 'no_vessels', 'clause': NULL, 'start': NULL, 'ss': NULL, 'mph': NULL}]
  ELSE [{'kind': 'no_motorboats', 'clause': '(1)', 'start': NULL, 'ss': NULL, 'mph': NULL}, {'kind': 'speed_limit', 'clause': '(1)', 'start': NULL, 'ss': NULL, 'mph': 15.0}, {'kind': 'no_towing', 'clause': '(2)', 'start': NULL, 'ss': NULL, 'mph': NULL}] END) AS r FROM p)
SELECT id, name, r.kind AS kind, r.clause AS clause, r.start AS "start", r.ss AS season_start, CAST(r.mph AS DOUBLE) AS speed_mph FROM n JOIN r USING (id)""")
def entry_records(spark, d):
    e = _framed(spark, d, HEADERS).withColumnRenamed("t", "header").join(_framed(spark, d, BODIES), "id")
    return clauses.records(e, "id", "header", "t").select("id", "name", "kind", "clause", "start", "season_start", "speed_mph")


ZONED = [
    "On the waters of Alder{} lake lying north of the {} bridge, it is unlawful to exceed a slow-no wake speed.",
    "It is unlawful to exceed a slow-no wake speed (north of the mill) on Alder{} lake.",
    "On that part of the lake known as Pike{} bay, no operator shall exceed a slow-no wake speed.\n(a) Upstream from the {} dam.\n(b) At any other place.",
    "It is unlawful to exceed a slow-no wake speed on:\n(a) Elm{} river from Bristol lake to Heron lake.\n(b) Channel connecting Alder{} lake to Holloway lake.",
    "Publisher's Note: the slow-no wake rule of Old Alder{} Lake was rescinded.",
]
ZONED_HEADERS = ["ALDER{} LAKE - R281.7.{}", "ALDER{} LAKE, SOUTH ARM", "ALDER{} LAKE", "RIVERS AND CHANNELS - WC-1-2-{}", "", "ALL CHANNELS CONNECTING ALDER{} LAKE AND BIRCH LAKE"]


@query("""WITH p AS (SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS k, p_partkey % 6 AS h, p_partkey // 6 % 5 AS b FROM part), c AS (SELECT *, unnest(CASE WHEN b IN (2, 3) THEN ['(a)', '(b)'] ELSE [NULL] END) AS clause, unnest(CASE WHEN b IN (2, 3) THEN [0, 1] ELSE [0] END) AS ord FROM p),
n AS (SELECT *, unnest(CASE WHEN h = 3 AND b = 3 THEN CASE ord WHEN 0 THEN ['Elm' || k || ' river'] ELSE ['Alder' || k || ' lake'] END WHEN h = 3 AND b = 2 THEN CASE ord WHEN 0 THEN ['Upstream from the ' || k || ' dam'] ELSE ['At any other place'] END WHEN h = 3 THEN ['Rivers']
  WHEN h = 4 THEN CASE WHEN b = 4 THEN ['Old Alder' || k || ' Lake'] ELSE [] END WHEN h = 5 THEN ['Alder' || k || ' Lake', 'Birch Lake'] ELSE ['Alder' || k || ' Lake'] END) AS name FROM c),
z AS (SELECT *, CASE WHEN h = 5 THEN 'all channels connecting Alder' || k || ' Lake and Birch Lake' WHEN h = 3 AND b = 3 AND ord = 1 THEN 'the channel connecting Alder' || k || ' Lake to Holloway Lake' END AS structure,
  CASE WHEN b = 0 THEN CASE WHEN length(k) < 3 THEN 'On the waters of Alder' || k || ' lake ' ELSE '' END || 'lying north of the ' || k || ' bridge' WHEN b = 2 AND ord = 0 THEN 'Upstream from the ' || k || ' dam' WHEN b = 2 THEN 'On that part of the lake known as Pike' || k || ' bay' WHEN h = 1 THEN 'South Arm' END AS zone FROM n)
SELECT id, ord, clause, name, 'slow_no_wake' AS kind, CASE WHEN structure IS NOT NULL THEN 'structure' WHEN zone IS NOT NULL THEN 'zone' ELSE 'lakewide' END AS scope, coalesce(structure, zone) AS description,
  CASE h WHEN 0 THEN 'R 281.7.' || k WHEN 3 THEN 'WC-1-2-' || k END AS rule_id FROM z""")
def scoped_entries(spark, d):
    k = F.col("p_partkey")
    frame = lambda frames, i: F.replace(F.get(F.array(*[F.lit(f) for f in frames]), i.cast("int")), F.lit("{}"), k.cast("string"))
    e = spread(read(spark, d, "part").select("p_partkey")).select(k.alias("id"), frame(ZONED_HEADERS, k % 6).alias("header"), frame(ZONED, F.floor(k / 6) % 5).alias("body"))
    return zones.scoped_records(e, "id", "header", "body").select("id", "ord", "clause", "name", "kind", "scope", "description", "rule_id")


@query()
def content_blocks(spark, d):
    return nodes.content_blocks(read(spark, d, "pages"), "page_id", "html", whole=True)
