r"""Benchmark decontamination by winnowing, natively on DataFrames.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z. Of every text's k-gram hashes, the smallest of each run of
`window - k + 1` neighbours is kept as a fingerprint; two texts that share `window` words therefore always share a fingerprint at
the same place of the shared span. Fingerprints are joined, and each hit is extended over the word hashes around it, which both
sides carry, to the shared windows themselves. Items shorter than a window are one window of their own length and are joined by
the hash of the whole.

Scale: one pass over the documents; the fingerprint rows carry their 15 words of context, so texts never move. The fingerprints
of the benchmark are broadcast if they, their contexts and their lists of items are few (all counted), else the join is shuffled; the row that stands for a document without hits has
a key of its own there, so no task gets them all. Equal fingerprints of several items are one row with a list of items, and the result is
grouped by document, never by passage.

Edge cases: null and blank texts have no words and no hits; rows with the same doc_id are judged each on its own, by their text, so
equal rows get equal results, a row each; an empty benchmark leaves every document clean; items without words never occur;
items without an id are one item, which is counted but has no name to list; further columns
of either table, of whatever name, are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_lists, text_key

#: Rows of fingerprints in a broadcast, at most; each holds about 16 numbers, and longer lists of items count more.
FINGERPRINT_ROWS = 250_000
NON_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The bits of a gram that are hash; those below hold its position.
HASH_MASK = -(1 << 30)


def word_hashes(text: Column) -> Column:
    """array<long>: a 64-bit hash of each word. lower() is used only where a word is all ASCII, so É stays É."""
    # translate() is slow; it is left to words that have both a letter beyond ASCII and something to lower.
    lowered = lambda w: F.when((F.octet_length(w) == F.length(w)) | (F.lower(w) == w), F.lower(w)).otherwise(F.translate(w, string.ascii_uppercase, string.ascii_lowercase))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), NON_WORD), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(lowered(w)))


def _gram(at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(F.col("wh"), at + i) for i in range(n)])


def _whole(n: int):
    """The n-gram at a place, for items that are n words long; made here since transform() would take a default argument for the place."""
    return lambda i: F.struct(i.cast("int").alias("p"), F.lit(n).alias("n"), _gram(i, n).alias("h"), F.array().cast("array<bigint>").alias("ctx"))


def _anchors(window: int, k: int, short: list[int], pad: int, whole_short: bool) -> Column:
    """array<struct<p, n, h, ctx>> of a row with `wh`: winnowed k-grams with context, and the n-grams of short lengths."""
    size, run, reach = F.size("wh"), window - k + 1, window - k
    # A gram is 34 bits of hash above its position, so the least of a run tells both what and where; of equal hashes it is the first.
    grams = F.transform(F.sequence(F.lit(0), size - k), lambda i: _gram(i, k).bitwiseAND(F.lit(HASH_MASK)).bitwiseOR(i.cast("long")))
    least_of = lambda g, h, by: F.zip_with(g, F.slice(h, by + 1, F.greatest(F.size(h) - by, F.lit(0))), lambda a, b: F.least(a, b))
    around = lambda p: F.transform(F.sequence(p - reach, p + window - 1), lambda i: F.when((i >= 0) & (i < size), F.get(F.col("wh"), i)).otherwise(F.lit(pad).cast("long")))
    bound = lambda value, use: F.flatten(F.transform(F.array(value), use))  # noqa: E731  computes `value` once a row

    def lowest(g: Column, have: int = 1) -> Column:
        """The least of every `run` neighbours, by doubling."""
        if have == run:
            return F.transform(F.array_distinct(F.slice(g, 1, size - k - run + 2)), lambda x: _mark(x))
        step = min(have, run - have)
        return bound(least_of(g, g, step), lambda m: lowest(m, have + step))

    def _mark(x: Column) -> Column:
        p = x.bitwiseAND(F.lit(~HASH_MASK)).cast("int")
        return F.struct(p.alias("p"), F.lit(window).alias("n"), x.bitwiseAND(F.lit(HASH_MASK)).alias("h"), around(p).alias("ctx"))

    picked = bound(grams, lambda g: lowest(g))
    none = F.array().cast("array<struct<p:int,n:int,h:bigint,ctx:array<bigint>>>")
    parts = [F.when(size >= window, picked).otherwise(none)]
    for n in short:
        whole = F.transform(F.sequence(F.lit(0), size - n), _whole(n))
        parts.append(F.when(size == n if whole_short else size >= n, whole).otherwise(none))
    return F.concat(*parts)


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """For each row of `docs` (doc_id, text): text_key, n_words, hit_words (positions), items (ids of the items found in it).

    `bench` has item_id and text. Columns beyond these are ignored.
    """
    items = bench.select("item_id", word_hashes(F.col("text")).alias("wh"))
    # At most window - 1 lengths are below a window: a bounded list for the driver.
    short = sorted(r[0] for r in items.where(F.size("wh").between(1, window - 1)).select(F.size("wh")).distinct().collect())
    marks = items.select("item_id", F.explode(_anchors(window, k, short, -2, True)).alias("a")).select("item_id", "a.*")
    marks = marks.groupBy("n", "h", F.col("ctx").alias("item_ctx")).agg(F.array_sort(F.collect_set(F.struct("item_id"))).alias("items"))  # structs, so a null id stays
    marks = small_lists(marks, "item_ctx", "items", most=16 * FINGERPRINT_ROWS)
    # The document's own row: n is 0, which no fingerprint has, and h spreads the documents over the tasks of a shuffled join.
    own = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).alias("n"), F.xxhash64("text_key", "doc_id").alias("h"), F.array().cast("array<bigint>").alias("ctx")))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), word_hashes(F.col("text")).alias("wh"))
    rows = rows.select("doc_id", "text_key", F.size("wh").alias("n_words"), F.explode(F.concat(own, _anchors(window, k, short, -1, False))).alias("a")).select("doc_id", "text_key", "n_words", "a.*")
    met = rows.join(marks, ["n", "h"], "left").where(F.col("items").isNotNull() | (F.col("p") < 0))
    starts = F.filter(F.sequence(F.lit(0), F.lit(window - k)), lambda o: F.slice(F.col("ctx"), o + 1, window) == F.slice(F.col("item_ctx"), o + 1, window))
    spans = F.flatten(F.transform(starts, lambda o: F.sequence(F.col("p") - (window - k) + o, F.col("p") + k - 1 + o)))
    covered = F.when(F.col("n") == window, spans).when(F.col("n") > 0, F.sequence(F.col("p"), F.col("p") + F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    met = met.select("doc_id", "text_key", "n_words", "p", covered.alias("covered"), "items")
    met = met.withColumn("items", F.when(F.size("covered") > 0, F.col("items")))
    found = met.groupBy("doc_id", "text_key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("covered")))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count_if(F.col("p") < 0).cast("int").alias("rows"),
    )
    found = found.withColumn("items", F.transform("items", lambda i: i["item_id"]))
    return found.withColumn("row", F.explode(F.sequence(F.lit(1), "rows"))).drop("row", "rows")


def report(hits: DataFrame) -> DataFrame:
    """The digest columns of `decontaminate`'s result."""
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return hits.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )
