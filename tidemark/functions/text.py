"""Names, keys, similarity and text extraction as Column expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that say what kind of water a name is of, abbreviations, and words that tell namesakes apart.
GENERIC = ("lake", "pond", "reservoir", "impoundment", "flowage", "basin")
ABBREVIATIONS = {"lk": "lake", "mt": "mount", "st": "saint", "n": "north", "s": "south", "e": "east", "w": "west", "upr": "upper", "lwr": "lower", "twp": "township"}
QUALIFIERS = ("big", "little", "north", "south", "east", "west", "upper", "lower", "middle")
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# The patterns that classify a rule's text, with what they mean, in order.
SHORE_BUFFER = r"(?i)within\s+100\s+feet\s+of\s+any\s+shore|maintain\s+a\s+distance\s+of\s+100\s+feet\s+from\s+the\s+shoreline"
AIRBOAT = r"\bairboat"
RAFT = r"rubber\s+rafts?|inflatable\s+raft|flotation|floating\s+device"
MOORING = r"moored,\s+docked,?\s+or\s+anchored|unlawful\s+to\s+anchor\s+or\s+moor|obstruct\s+or\s+restrict\s+the\s+passage"
HEADCOUNT = r"more\s+than\s+\d+\s+persons?\s+at\s+\d+\s+time"
NOT_APPLICABLE = f"(?i){AIRBOAT}|{RAFT}|{MOORING}|{HEADCOUNT}"  # one kind for all four
SWIM_AREA = r"(?i)areas?\s+prohibited\s+to\s+boating|swimming,?\s+bathing\s+or\s+wading|swim\s+areas?|swimming\s+areas?"
PERSONAL_CRAFT = r"(?i)personal\s+watercraft|\bPWC\b|jet\s?ski"
ELECTRIC_ONLY = r"(?i)except\s+an\s+electric\s+motor|other\s+tha[nt]\s+an\s+electric|electric\s+motors?\s+only|except\s+electric\s+motors?"
MOTORBOAT_BAN = r"(?i)unlawful\s+to\s+operate\s+a\s+motorboat|motorboats?\s+(?:are|is)\s+prohibited|no\s+motorboats?\s+(?:shall|may)\s+be\s+operated|prohibition\s+of\s+motorboats"
VESSEL_BAN = r"(?i)boating\s+is\s+prohibited|no\s+vessel\s+shall\s+operate|vessels?\s+(?:are|is)\s+prohibited|prohibition\s+of\s+vessels"
HIGH_SPEED = r"(?i)high[\s-]?speed|plan[in]{1,3}g\s+condition"
SLOW_NO_WAKE = r"(?i)slow-?-?\s?no[\s-]?wake"
TOWING = r"(?i)have\s+in\s+tow|assist(?:ing)?\s+in\s+the\s+propulsion|water\s*ski|water\s*sled|to\s+tow\b"
SPEED = r"(?i)(\d{1,3}(?:\.\d+)?)\s*(?:statute\s+)?miles?\s+per\s+hour"
TIME = r"\d{1,2}:\d{2}\s*[ap]\.?\s?m\.?"
HOURS = rf"(?i)(?:between(?:\s+the\s+hours(?:\s+of)?)?|from|during\s+the\s+period\s+of)\s+({TIME})\s*(?:and|to|until)\s*({TIME})"
SUNSET = r"(?i)(\d+\s+hours?\s+after\s+sunset\s+to\s+\d+\s+hours?\s+before\s+sunrise)"
HOLIDAYS = r"(?i)Memorial\s+Day\s+(?:through|to|until)\s+Labor\s+Day"
MONTH_LIST = rf"(?i)during\s+(?:the\s+months?\s+of\s+)?((?:(?:{'|'.join(MONTHS)})(?:(?:\s*,\s*|\s+)(?:and\s+)?)?)+)"


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _segment(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), "[̀-ͯ]", ""), r"[^a-z0-9]+", " ")), " ")
    full = F.transform(words, lambda w: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), w), w))
    generic = lambda w: w.isin(*GENERIC)
    # A name of generic words alone keeps one: the last, as leading ones go first.
    places = lambda a: F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: ~generic(F.element_at(a, i)))
    kept = F.transform(F.array(full), lambda a: F.when(F.size(places(a)) == 0, F.slice(a, -1, 1)).otherwise(F.slice(a, F.array_min(places(a)), F.array_max(places(a)) - F.array_min(places(a)) + 1)))
    return F.array_join(F.get(kept, F.lit(0)), " ")


def normalize_name(raw: Column) -> Column:
    """Lower-case words without accents and punctuation, abbreviations written out, generic words cut from both ends; parentheses are segments of their own.

    Null gives the empty string.
    """
    raw = F.coalesce(raw, F.lit(""))
    parts = F.concat(F.array(F.regexp_replace(raw, r"\([^)]*\)", " ")), F.regexp_extract_all(raw, F.lit(r"\(([^)]*)\)"), 1))
    return F.array_join(F.filter(F.transform(parts, _segment), lambda s: s != ""), " ")


def words(norm: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm, " "), lambda w: w != ""))


def qualifiers(norm: Column) -> Column:
    """The distinct qualifier words of a normalized name, sorted."""
    return F.array_sort(F.filter(words(norm), lambda w: w.isin(*QUALIFIERS)))


def strip_qualifiers(norm: Column) -> Column:
    """The name without qualifier words; as it is if nothing else is left."""
    rest = F.array_join(F.filter(F.split(norm, " "), lambda w: ~w.isin(*QUALIFIERS)), " ")
    return F.when(rest == "", norm).otherwise(rest)


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two strings, for which Spark has no function."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def name_score(a: Column, b: Column, ratio: Column | None = None) -> Column:
    """How alike two normalized names are: 1 if equal, 0.6 if equal but for qualifiers (0.15 if those conflict), else by words and, given `ratio`, by spelling."""
    qa, qb = qualifiers(a), qualifiers(b)
    conflict = (F.size(qa) > 0) & (F.size(qb) > 0) & (qa != qb)
    rest = F.lit(0.4) * jaccard(words(a), words(b))
    if ratio is not None:
        rest = F.greatest(rest, F.when(ratio >= 0.85, 0.5 * ratio).otherwise(0.0))
    score = F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(strip_qualifiers(a) == strip_qualifiers(b), F.when(conflict, 0.15).otherwise(0.6)).otherwise(rest)
    return F.coalesce(score, F.lit(0.0))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the text with two blanks before and one after."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def trigram_score(query: Column, target: Column) -> Column:
    """0.65 of the share of the query's trigrams that the target has, and 0.35 of Dice's coefficient."""
    shared = F.size(F.array_intersect(query, target))
    return 0.65 * shared / F.size(query) + 0.35 * (2 * shared / (F.size(query) + F.size(target)))


def hash_key(*parts: Column, digits: int = 12) -> Column:
    """The first hexadecimal digits of a SHA-1 of parts joined by |; null parts are empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, digits)


def hash_id(key: Column) -> Column:
    """A positive 31-bit number of a SHA-1."""
    return F.conv(F.substring(F.sha1(key.cast("binary")), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def speed_mph(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, SPEED, 1), F.lit("")).cast("double")


def clock(text: Column) -> Column:
    """`8:30 p.m.` as `20:30`; null if it is no such time."""
    part = lambda i: F.regexp_extract(text, r"(?i)(\d{1,2}):(\d{2})\s*([ap])", i)
    hour = F.nullif(part(1), F.lit("")).cast("int") % 12 + F.when(F.lower(part(3)) == "p", 12).otherwise(0)
    return F.when(part(1) != "", F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), part(2)))


def hours(text: Column) -> Column:
    """struct(start, end) of a text's time window in 24-hour form; null if it has none."""
    start, end = clock(F.regexp_extract(text, HOURS, 1)), clock(F.regexp_extract(text, HOURS, 2))
    return F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def season(text: Column) -> Column:
    """struct(start, end) as MM-dd: the summer holidays, or from the first to the last month of a list; null if there is none."""
    names = F.regexp_extract_all(F.lower(F.regexp_extract(text, MONTH_LIST, 1)), F.lit("(" + "|".join(MONTHS) + ")"), 1)
    number = lambda i: F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.element_at(names, i)).cast("int")
    last = F.date_format(F.last_day(F.make_date(F.lit(2023), number(-1), F.lit(1))), "MM-dd")
    months = F.when(F.size(names) > 0, F.struct(F.format_string("%02d-01", number(1)).alias("start"), last.alias("end")))
    return F.when(text.rlike(HOLIDAYS), F.struct(F.lit("05-25").alias("start"), F.lit("09-07").alias("end"))).otherwise(months)


def rule_kinds(text: Column) -> Column:
    """array<string>: what a rule's text forbids, by the first pattern in order that fits; a speed may come with a motorboat ban."""
    speed, banned = F.coalesce(text.rlike(SPEED), F.lit(False)), text.rlike(MOTORBOAT_BAN)
    kinds = lambda *k: F.array(*[F.lit(x) for x in k])
    timed = text.rlike(HOURS) | text.rlike(SUNSET)
    return (
        F.when(text.rlike(SHORE_BUFFER), kinds("shore_buffer"))
        .when(text.rlike(NOT_APPLICABLE), kinds("not_applicable"))
        .when(text.rlike(SWIM_AREA) & ~text.rlike(SLOW_NO_WAKE) & ~text.rlike(HIGH_SPEED), kinds("not_applicable"))
        .when(text.rlike(PERSONAL_CRAFT), kinds("no_pwc"))
        .when(speed & (text.rlike(ELECTRIC_ONLY) | banned), kinds("no_motorboats", "speed_limit"))
        .when(speed, kinds("speed_limit"))
        .when(text.rlike(ELECTRIC_ONLY) | banned, kinds("no_motorboats"))
        .when(text.rlike(VESSEL_BAN), kinds("no_vessels"))
        .when(text.rlike(HIGH_SPEED), F.when(timed, kinds("high_speed_hours")).otherwise(kinds("no_high_speed")))
        .when(text.rlike(SLOW_NO_WAKE), kinds("slow_no_wake"))
        .when(text.rlike(TOWING), kinds("no_towing"))
        .otherwise(kinds("other"))
    )


def survey_keys(text: Column) -> Column:
    """array<string>: `04N07E16` for every section number, with the township and range that follow it in `section 16, T4N, R7E`.

    Long forms (`town 4 north, range 7 east`) are read as short ones; sections outside 1 to 36 are dropped.
    """
    short = text
    for word, letter in (("north", "N"), ("south", "S")):
        short = F.regexp_replace(short, rf"(?i)\btown(?:ship)?\s+(\d{{1,3}})\s+{word}\b", f"T$1{letter}")
    for word, letter in (("east", "E"), ("west", "W")):
        short = F.regexp_replace(short, rf"(?i)\brange\s+(\d{{1,3}})\s+{word}\b", f"R$1{letter}")
    group = r"(?i:sections?)\s+((?:\d{1,3}(?:\s*(?:,|,?\s*and|&)\s*)?)+),?\s*T\s?(\d{1,3})\s?([NS]),?\s*R\s?(\d{1,3})\s?([EW])"
    found = F.regexp_extract_all(short, F.lit(group), 0)

    def keys(g: Column) -> Column:
        part = lambda i: F.regexp_extract(g, group, i)
        place = F.concat(F.lpad(part(2), 2, "0"), part(3), F.lpad(part(4), 2, "0"), part(5))
        numbers = F.transform(F.regexp_extract_all(part(1), F.lit(r"(\d{1,3})"), 1), lambda x: x.cast("int"))
        return F.transform(F.filter(numbers, lambda x: x.between(1, 36)), lambda x: F.concat(place, F.lpad(x.cast("string"), 2, "0")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, keys))))


def visibility_sm(text: Column) -> Column:
    """`1 1/2`, `6+`, `P6SM`, `3/4SM` as miles; null if it is no number."""
    clean = F.trim(F.regexp_replace(F.upper(text), r"SM|\+|^[PM]", ""))
    whole = F.regexp_extract(clean, r"^(\d+(?:\.\d+)?)(?:\s|$)", 1)
    top, below = (F.regexp_extract(clean, r"(?:^|\s)(\d+)/(\d+)$", i) for i in (1, 2))
    number = lambda x: F.expr("null").cast("double") if x is None else F.nullif(x, F.lit("")).cast("double")
    fraction = F.try_divide(number(top), number(below))
    return F.when((whole != "") | (top != ""), F.coalesce(number(whole), F.lit(0.0)) + F.coalesce(fraction, F.lit(0.0)))
