r"""Importance resampling toward a target distribution, natively on DataFrames.

A text's features are its runs of `low` to `high` words, hashed into `buckets` buckets by CRC-32. A bucket's gain is the logarithm of
how much likelier the target texts are to hold it than the corpus is, smoothed by one in each bucket, in whole thousandths. A document's weight is
the mean gain of its features; with Gumbel noise from a hash of its id added, the documents of the highest scores are a draw without
replacement by importance.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.

Scale: the texts are read twice, once to count the buckets and once to sum gains; both passes explode the features and add them up before
they shuffle, by bucket (at most `buckets` rows a task) or by document. The gain table has exactly `buckets` rows, which bounds its broadcast. Ranks need no
single task: the eligible documents are sorted over all partitions and written, and a place is the rows of the partitions before plus the place
within the own one.

Edge cases: null and blank texts have no features and weight 0; a null doc_id is hashed as "null" and ranks last among equal scores; rows that agree
in doc_id and text have equal scores and one rank each; an empty corpus gives an empty result, an empty target gains from its smoothing
alone; further columns of either table, of whatever name, are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, small, text_key, written
from tidemark.llm.decontam import NON_WORD

#: monotonically_increasing_id() holds the partition above these bits, and the place within it below.
PLACE_BITS = 33
#: Rows that one array of copies stands for, at most.
COPIES = 10_000


def ascii_words(text: Column) -> Column:
    """array<string>: the words, with A-Z alone lower-cased."""
    # translate() is slow; it is left to words that have both a letter beyond ASCII and something to lower.
    lowered = lambda w: F.when((F.octet_length(w) == F.length(w)) | (F.lower(w) == w), F.lower(w)).otherwise(F.translate(w, string.ascii_uppercase, string.ascii_lowercase))
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), NON_WORD), lambda w: w != ""), lowered)


def _runs(n: int):
    """The run of n words that starts at a place; made here since transform() would take a default argument for the place."""
    return lambda i: F.array_join(F.slice("words", i + 1, n), " ")


def features(low: int, high: int) -> Column:
    """array<string>: the runs of `low` to `high` words of a row with `words`."""
    none = F.array().cast("array<string>")
    parts = [F.col("words") if n == 1 else F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(0), F.size("words") - n), _runs(n))).otherwise(none) for n in range(low, high + 1)]
    return F.concat(*parts)


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, low: int, high: int, buckets: int) -> DataFrame:
    """(bucket, n) of the features of all texts."""
    found = texts.select(ascii_words(F.col("text")).alias("words")).select(F.explode(features(low, high)).alias("feature"))
    return found.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) for each of the `buckets` buckets: thousandths of the logarithm of the smoothed ratio, floored."""
    ours = written(bucket_counts(docs, low, high, buckets), "bucket-counts")
    theirs = written(bucket_counts(target, low, high, buckets), "bucket-counts")
    total = lambda counts: float(counts.agg(F.sum("n")).first()[0] or 0)
    s_all, t_all = total(ours), total(theirs)
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    table = every.join(ours.withColumnRenamed("n", "s"), "bucket", "left").join(theirs.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") + 1.0 for c in ("s", "t"))
    out = written(table.select("bucket", F.floor(F.log(t * F.lit(s_all + buckets) / (s * F.lit(t_all + buckets))) * 1000.0).alias("gain")), "gains")
    discard(ours)
    discard(theirs)
    return out


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in whole thousandths, floored: from the first 32 bits of a SHA-256 of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)


def _each_copy(df: DataFrame) -> DataFrame:
    """A row for each of `rows` copies, numbered by `copy`; two steps, so that no array is as long as a large group."""
    outer = df.withColumn("thousands", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / COPIES))))
    first, last = F.col("thousands") * COPIES, F.least(F.col("rows"), (F.col("thousands") + 1) * COPIES) - 1
    return outer.withColumn("copy", F.explode(F.sequence(first, last))).drop("thousands", "rows")


def weights(docs: DataFrame, gain: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000) -> DataFrame:
    """For each row of `docs`: doc_id, text_key, copy, n_words, n_features, weight."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), ascii_words(F.col("text")).alias("words"))
    # A null feature stands for the document itself: it has no bucket, and tells how many rows agree in doc_id and text.
    itself = F.array(F.lit(None).cast("string"))
    exploded = rows.select("doc_id", "text_key", F.size("words").alias("n_words"), F.explode(F.concat(itself, features(low, high))).alias("feature"))
    exploded = exploded.select("doc_id", "text_key", "n_words", bucket(F.col("feature"), buckets).alias("bucket"))
    met = exploded.join(F.broadcast(gain), "bucket", "left")  # `buckets` rows exactly
    per = met.groupBy("doc_id", "text_key").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count("bucket").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"), F.count_if(F.col("bucket").isNull()).alias("rows")
    )
    floored = F.when(F.col("n") == 0, F.lit(0)).otherwise(F.expr("(total - pmod(total, greatest(n, 1))) div greatest(n, 1)")).cast("long")
    per = per.select("doc_id", "text_key", "n_words", F.expr("n div rows").alias("n_features"), floored.alias("weight"), "rows")
    return _each_copy(per)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """`rows` with `rank` from 1 in the given order, which must tell all rows apart. A distributed sort; only the counts of its partitions are added up in one place."""
    rows = written(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("place", PLACE_BITS)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition of the sort
    before = counts.select("part", (F.sum("n").over(Window.partitionBy().orderBy("part")) - F.col("n")).alias("before"))
    found = rows.withColumn("part", part).join(small(written(before, "offsets")), "part")
    return found.withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1).drop("part", "place", "before")


def resample(
    docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, seed: str = "2024", min_words: int = 20, percent: int = 10
) -> DataFrame:
    """For each row of `docs` (doc_id, text): text_key, n_features, weight, score, and rank (null where not drawn).

    `percent` in a hundred of the documents with `min_words` words or more are drawn; `target` has a column text.
    """
    gain = gains(docs, target, low, high, buckets)
    scored = weights(docs, gain, low, high, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored, "scored")
    discard(gain)
    eligible = scored.where(F.col("n_words") >= min_words)
    drawn = eligible.count() * percent // 100
    placed = ranked(eligible, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("text_key"), F.asc("copy"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(others).drop("copy", "n_words")
