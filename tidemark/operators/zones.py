"""What part of a water a rule is about: zones in the words of a clause, structures that connect waters, and clauses that name their own waters.

All are Column expressions and joins by entry; texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import headers, text
from tidemark.operators import clauses, matching

# What begins the description of a zone, what ends it, survey references, and words of a header that name a part of a water.
ZONE_TRIGGERS = [
    r"north(?:erly|east|west)?(?:ly)?\s+(?:of|from)\b",
    r"south(?:erly|east|west)?(?:ly)?\s+(?:of|from)\b",
    r"east(?:erly)?\s+(?:of|from)\b",
    r"west(?:erly)?\s+(?:of|from)\b",
    r"\bbeginning\s+(?:at|where)\b",
    r"\benclosed by a line\b",
    r"\bbetween a line\b",
    r"\bbetween day beacons\b",
    r"\bfor a distance of\s+\d+\s+feet\b",
    r"\bthat\s+(?:part|portion)\s+of\b",
    r"\bthose\s+portions\s+of\b",
    r"\bon\s+that\s+part\b",
    r"\bin\s+the\s+(?:northerly|southerly|easterly|westerly|north|south|east|west)\b[^,]{0,40}\btip\b",
    r"\b\d\s*/\s*\d\s+of\s+the\b",
    r"\bknown\s+(?:locally\s+)?as\b",
    r"\bbays?\b",
    r"\blying\s+(?:west|east|north|south)\b",
    r"\bupstream\b",
    r"\bdownstream\b",
    r"\badjacent\s+to\b",
    r"\bfrom\s+the\s+mouth\b",
    r"\bbasin\b",
]
ZONE_STOP = r"(?i),\s*(?:it\s+is\s+unlawful|it\s+shall\s+be\s+unlawful|an?\s+operator|no\s+operator|the\s+following\s+controls|persons\s+operating)"
SURVEY = r"(?i)\b(?:town|range)\s+\d{1,3}\s+(?:north|south|east|west)\b|\bT\s?\d{1,3}\s?[NS]\b|\bR\s?\d{1,3}\s?[EW]\b"
PART_WORDS = [
    "bay", "bays", "basin", "part", "parts", "portion", "portions", "tip", "section", "sections", "township", "townhip", "twsp", "city", "village", "adjoining", "access", "site",
    "arm", "north", "south", "east", "west", "northeast", "northwest", "southeast", "southwest", "northerly", "southerly", "easterly", "westerly", "upper", "lower", "middle",
]
# How far back a zone's first words may begin, and the most letters of a description.
BACK, LONGEST = 30, 400
# A header or clause that opens with a connecting structure, with what it does, and one that only opens with its noun.
STRUCTURE_HEAD = r"(?i)^(?:the\s+)?(?:all\s+)?(?:artificial\s+|natural\s+)?(?:channels?|canals?|lagoons?)\s+(?:connecting|connected\s+to|connected|between|joining|to)\s+"
STRUCTURE_NOUN = r"(?i)^(?:the\s+)?(?:all\s+)?(?:artificial\s+|natural\s+)?(?:channels?|canals?|lagoons?)\b"
# Words in a clause's own name at most, sentence ends, and abbreviations that are none.
NAME_WORDS, SENTENCE_END, ABBREVIATION = 6, r"(?<=[.;:])\s+", r"\b[A-Z][A-Za-z]{0,2}\.$"
# The name of a water in a publisher's note.
NOTE = r"(?i:Publisher'?s?\s+Note)"
NOTE_NAME, NOTE_LAKE = r"\b((?:[A-Z][\w'.-]+\s+)+?[Ll]ake)\b", r"\b[Ll]ake\s+([A-Z][\w'.-]+)"

EDGES = r"^[ .;,]+|[ .;,]+$"


def _masked(t: Column) -> Column:
    """The text with everything inside parentheses blotted out, letter for letter; what follows an unclosed one counts as inside."""
    add = lambda s, p: F.when(p == "(", F.struct((s["depth"] + 1).alias("depth"), F.concat(s["out"], p).alias("out"))).when(
        p == ")", F.struct((s["depth"] - 1).alias("depth"), F.concat(s["out"], p).alias("out"))
    ).otherwise(F.struct(s["depth"].alias("depth"), F.concat(s["out"], F.when(s["depth"] > 0, F.repeat(F.lit("\u0003"), F.length(p))).otherwise(p)).alias("out")))
    scan = F.aggregate(F.regexp_extract_all(t, F.lit(r"([^()]+|[()])"), F.lit(1)), F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), add, lambda s: s["out"])
    return F.when(t.contains("("), scan).otherwise(t)


def zone_description(t: Column) -> Column:
    """The phrase of a text that tells a part of a water, from its first trigger outside parentheses; null if it tells none.

    It begins after a comma at most BACK letters before, ends before the ban itself, and is cut off at LONGEST letters. Cross references and survey references count for nothing.
    """
    clean = F.regexp_replace(headers.without_cross_references(F.coalesce(t, F.lit(""))), SURVEY, " ")

    def described(s: Column) -> Column:
        head = F.substring(s["clean"], F.lit(1), s["at"] - 1)
        comma = F.instr(F.reverse(head), ",")
        back = F.when(comma > 0, F.length(head) - comma + 1).otherwise(0)
        first = F.when(s["at"] - 1 - back <= BACK, back).otherwise(s["at"] - 1)
        tail = F.substring(s["clean"], first + 1, F.length(s["clean"]))
        body = F.regexp_replace(headers.squeezed(F.get(F.split(tail, ZONE_STOP, 2), F.lit(0))), r"(?:,\s*){2,}", ", ")
        out = F.regexp_replace(body, EDGES, "")
        short = F.when(F.length(out) > LONGEST, F.concat(F.rtrim(F.substring(out, 1, LONGEST - 3)), F.lit("..."))).otherwise(out)
        return F.when(s["at"] > 0, F.nullif(short, F.lit("")))

    at = lambda c: F.struct(c.alias("clean"), F.regexp_instr(_masked(c), F.lit("(?i)" + "|".join(ZONE_TRIGGERS))).alias("at"))
    return clauses._held(clauses._held(clean, at), described)


def part_names(header: Column) -> Column:
    """array<string>: the segments of a header that tell a part of a water."""
    words = lambda s: F.regexp_extract_all(F.lower(s), F.lit("([a-z]+)"), F.lit(1))
    return F.filter(clauses.part_segments(header), lambda s: F.exists(words(s), lambda w: w.isin(PART_WORDS)))


def zone(header: Column, *texts: Column) -> Column:
    """struct(scope, description): `zone` with the description of the first text that tells one, else of the header's parts; `lakewide` without any."""
    listed = F.nullif(F.array_join(part_names(header), ", "), F.lit(""))
    found = F.coalesce(*[zone_description(t) for t in texts], listed)
    return F.struct(F.when(found.isNull(), "lakewide").otherwise("zone").alias("scope"), found.alias("description"))


def _phrase(t: Column) -> Column:
    """Words in capitals or small letters alone with a capital first, small words but the first in small letters; others stay."""
    tokens = F.regexp_extract_all(headers.squeezed(t), F.lit(r"([A-Za-z][A-Za-z']*|[^A-Za-z]+)"), F.lit(1))
    first = F.when(F.get(tokens, F.lit(0)).rlike("^[A-Za-z]"), 0).otherwise(1)

    def word(x: Column, i: Column) -> Column:
        low = F.lower(x)
        raised = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1_000_000))
        return F.when((i > first) & low.isin(headers.SMALL_WORDS), low).when((x == F.upper(x)) | (x == low), raised).otherwise(x)

    return F.array_join(F.transform(tokens, word), "")


def connecting_structure(raw: Column) -> Column:
    """`the channel connecting Brown Lake to Rowan Lake`, where that is all a header or clause names; null where it names a water of its own."""
    t = headers.title_case(raw)
    head = F.lower(headers.squeezed(F.regexp_extract(t, f"({STRUCTURE_HEAD})", 1)))
    rest = _phrase(F.regexp_replace(F.regexp_replace(t, STRUCTURE_HEAD, ""), EDGES, ""))
    resolved = clauses._held(clauses.water_names(raw), lambda names: (F.size(names) > 0) & ~F.exists(names, lambda n: n.rlike(STRUCTURE_NOUN)))
    whole = F.concat(F.when(head.rlike(r"^(?:the|all)\b"), "").otherwise("the "), head, F.lit(" "), rest)
    return F.when((head != "") & (rest != "") & resolved, whole)


def first_sentence(t: Column) -> Column:
    """The text up to the first end of a sentence that is no abbreviation such as `St.` or `No.`."""
    pieces, gaps = F.split(t, SENTENCE_END), F.regexp_extract_all(t, F.lit(rf"({SENTENCE_END})"), F.lit(1))

    def add(s: Column, p: Column) -> Column:
        longer = F.concat(s["text"], s["gap"], p["piece"])
        return F.when(s["done"], s).otherwise(F.struct(longer.alias("text"), F.coalesce(p["gap"], F.lit("")).alias("gap"), (~longer.rlike(ABBREVIATION)).alias("done")))

    start = F.struct(F.lit("").alias("text"), F.lit("").alias("gap"), F.lit(False).alias("done"))
    return F.aggregate(F.zip_with(pieces, gaps, lambda p, g: F.struct(p.alias("piece"), g.alias("gap"))), start, add, lambda s: s["text"])


def note_name(t: Column) -> Column:
    """The water that a publisher's note names; null without one."""
    named = F.regexp_extract(t, NOTE_NAME, 1)
    lake = F.regexp_extract(t, NOTE_LAKE, 1)
    return F.when(named != "", headers.squeezed(named)).when(lake != "", F.concat(F.lit("Lake "), lake))


def own_names(found: DataFrame, key: str, header: str) -> DataFrame:
    """`found` (clauses: key, label, text, a header) with `listed`, the header's waters, `own`, those that each clause itself names, and `own_source`, the words that do.

    The last two are null unless every name in the header is only a kind of water, the entry is a list of two clauses or more, and each of them names some: then the
    header labels the list.
    """
    source = F.regexp_replace(first_sentence(F.trim("text")), EDGES, "")
    named = found.withColumn("_source", source).withColumn("_own", clauses.water_names(F.col("_source"))).withColumn("listed", clauses.water_names(F.col(header)))
    proper = (F.size("_own") > 0) & F.forall("_own", lambda n: ~headers.generic_only(n) & (F.size(F.split(n, r"\s+")) <= NAME_WORDS))
    labels = (F.size("listed") > 0) & F.forall("listed", headers.generic_only)
    entry = named.groupBy(key).agg((F.bool_and(labels) & F.bool_and(F.col("label").isNotNull()) & F.bool_and(proper) & (F.count("*") > 1)).alias("_list"))
    out = named.join(entry, key)
    return out.select(*[F.col(c) for c in found.columns], "listed", F.when(F.col("_list"), F.col("_own")).alias("own"), F.when(F.col("_list"), F.col("_source")).alias("own_source"))


def scoped_records(entries: DataFrame, key: str, header: str, body: str) -> DataFrame:
    """(key, ord, clause, name, norm, kind, scope, description, rule_id, record_id): a record for each clause, kind and water of each entry, with the part of the water that it is about.

    Waters are the clause's own where the header only labels a list, else the header's; an entry without any has the one in its publisher's note. A zone in the
    clause goes before one in the words before the list, then come the header's parts; a header or clause that names but a connecting structure is described by it.
    """
    e = entries.select(key, F.coalesce(F.col(header), F.lit("")).alias("_header"), F.coalesce(F.col(body), F.lit("")).alias("_body"))
    e = e.withColumn("rule_id", headers.first_rule_id(F.concat_ws(" ", "_header", "_body"))).withColumn("_note", note_name(F.regexp_extract("_body", f"({NOTE}[^\\n]*)", 1)))
    e = e.withColumn("_header", F.regexp_replace("_header", rf"[\s–—-]*(?:{headers.RULE_R}|{headers.RULE_WC}).*$", ""))  # a rule's number is no part of a name
    found = own_names(clauses.merge_towing(clauses.with_kinds(clauses.split(e, "_body")), key), key, "_header")
    structure = F.coalesce(connecting_structure(F.col("own_source")), F.when(F.col("own").isNull(), connecting_structure(F.col("_header"))))
    scoped = found.withColumn("_zone", zone(F.col("_header"), F.col("text"), F.col("preamble"))).withColumn("_structure", structure)
    names = F.when(F.col("own").isNotNull(), F.col("own")).when(F.size("listed") > 0, F.col("listed")).when(F.col("_note").isNotNull(), F.array("_note")).otherwise(F.array().cast("array<string>"))
    rows = scoped.withColumn("_names", names).select(
        key, "ord", F.col("label").alias("clause"), "rule_id", "_names", F.posexplode("kinds").alias("_k", "kind"),
        F.when(F.col("_structure").isNotNull(), "structure").otherwise(F.col("_zone.scope")).alias("scope"), F.coalesce("_structure", "_zone.description").alias("description"),
    ).select(key, "ord", "clause", "rule_id", "_k", "kind", "scope", "description", F.posexplode("_names").alias("_o", "name"))
    out = rows.withColumn("norm", text.normalize_name(F.col("name"))).withColumn("_place", F.struct("ord", "_k", "_o")).withColumn("record_id", F.concat_ws("/", F.col(key).cast("string"), "norm", "kind"))
    kept = [key, "ord", "clause", "name", "norm", "kind", "scope", "description", "rule_id"]
    return matching.numbered(out, [key], "record_id", "_place").select(*kept, "record_id")
