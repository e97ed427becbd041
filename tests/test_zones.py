"""Zones, structures and clause names on written texts, with what each must give."""

from pyspark.sql import functions as F

from tidemark.operators import zones


def one(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_zone_descriptions(spark):
    long = "On that part of the lake " + "lying along the shore " * 40
    texts = {
        "On the waters of Oak lake, north of the bridge, it is unlawful to exceed a slow speed.": "north of the bridge",
        "On all waters of the lake lying east of a line from here to there (see north of town), an operator shall not go fast.": "On all waters of the lake lying east of a line from here to there",
        "On Oak lake (north of town 5 north), it is unlawful to race.": None,  # inside parentheses, and a survey reference
        "On the waters of Big lake (See R281.747.1 for the bay), it is unlawful": None,
        "Section 3, town 12 north, range 7 west, upstream from the dam, no operator shall": "upstream from the dam",
        "the open ( parenthesis north of the inlet": None,
        "closed ) first, then south of the inlet": "then south of the inlet",
        "It is unlawful on the entire lake": None,
        "": None,
        None: None,
        long: long[:397].rstrip() + "...",
        "Beginning at the dock, , , and for a distance of 300 feet; ": "Beginning at the dock, and for a distance of 300 feet",
    }
    assert one(spark, texts, zones.zone_description) == list(texts.values())


def test_zones_by_priority(spark):
    df = spark.createDataFrame([("OAK LAKE", "no zone", "north of the mill"), ("OAK LAKE", "in Miller Bay", "north of the mill"), ("OAK LAKE, MILLER BAY", "x", None), ("OAK LAKE", "x", None)], "h string, a string, b string")
    got = [tuple(r.z) for r in df.select(zones.zone(F.col("h"), F.col("a"), F.col("b")).alias("z")).collect()]
    assert got == [("zone", "north of the mill"), ("zone", "in Miller Bay"), ("zone", "Miller Bay"), ("lakewide", None)]


def test_connecting_structures(spark):
    texts = {
        "Channel connecting Crooked lake to Holloway lake.": "the channel connecting Crooked Lake to Holloway Lake",
        "CANALS CONNECTED TO WILLOW LAKE": "the canals connected to Willow Lake",
        "ALL CHANNELS CONNECTING BROWN LAKE AND ROWAN LAKE": "all channels connecting Brown Lake and Rowan Lake",
        "BIG AND LITTLE STONE HILL LAKES AND CONNECTING CHANNEL": None,
        "HERON RIVER": None,
        "CHANNEL BETWEEN SPRUCE AND AMBER LAKES": None,
        "": None,
        None: None,
    }
    assert one(spark, texts, zones.connecting_structure) == list(texts.values())


def test_first_sentences(spark):
    texts = {
        "Heron river. From Bristol lake": "Heron river.",
        "Channel connecting Everton lake to St. Clair lake. No speed": "Channel connecting Everton lake to St. Clair lake.",
        "One; two": "One;",
        "no end": "no end",
        "Mt. No. St.": "Mt. No. St.",
        "": "",
    }
    assert one(spark, texts, zones.first_sentence) == list(texts.values())


def test_note_names(spark):
    texts = {"Publisher's Note: the rule for Big Oak Lake was rescinded.": "Big Oak Lake", "Lake Orion has none": "Lake Orion", "no water": None, "Upper  Long lake and Lake Erie": "Upper Long lake"}
    assert one(spark, texts, zones.note_name) == list(texts.values())


def test_scoped_records(spark):
    entries = [
        (1, "RIVERS AND CHANNELS - R281.705.1", "It is unlawful to exceed a slow-no wake speed on:\n(a) Heron river from Bristol lake to Heron lake.\n(b) Channel connecting Crooked lake to Holloway lake."),
        (2, "OAK LAKE", "On the waters of Oak lake, it is unlawful to exceed a slow-no wake speed:\n(a) North of the bridge, at any time.\n(b) At any other place."),
        (3, "OAK LAKE, MILLER BAY", "1. It is unlawful to exceed a slow-no wake speed. R 281.1.2"),
        (4, "CHANNELS", "It is unlawful to exceed a slow-no wake speed on:\n(a) Rivers.\n(b) Heron river."),
        (5, "", "Publisher's Note: the slow-no wake rule of Big Oak Lake was rescinded."),
        (6, None, None),
    ]
    df = spark.createDataFrame(entries, "id int, header string, body string")
    got = {(r.id, r.ord): (r.clause, r["name"], r.kind, r.scope, r.description, r.rule_id) for r in zones.scoped_records(df, "id", "header", "body").collect()}
    assert {k[0] for k in got} >= {1, 2, 3, 4, 5}
    assert got[1, 0][1] == "Heron river" and got[1, 0][5] == "R 281.705.1"
    assert got[1, 1][3:5] == ("structure", "the channel connecting Crooked Lake to Holloway Lake")
    assert got[2, 0][3:5] == ("zone", "North of the bridge, at any time") and got[2, 1][3:5] == ("lakewide", None) and got[2, 1][1] == "Oak Lake"
    assert got[3, 0][3:] == ("zone", "Miller Bay", "R 281.1.2")
    assert got[4, 0][1] == got[4, 1][1] == "Channels"  # one clause names only a kind of water, so the header stands
    assert got[5, 0][1] == "Big Oak Lake"


def test_long_rule_numbers_stay_whole(spark):
    e = spark.createDataFrame([(1, "RIVERS AND CHANNELS - WC-1-2-10185", "It is unlawful to exceed a slow-no wake speed.")], "id int, h string, b string")
    assert [r["rule_id"] for r in zones.scoped_records(e, "id", "h", "b").collect()] == ["WC-1-2-10185"]
