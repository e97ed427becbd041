"""Mixing sources to target weights: Efraimidis-Spirakis sampling without replacement, natively on DataFrames.

Every source gets a share of the corpus by its weight, at most `cap` times its own size; what a capped source cannot take
goes to the others by weight. A target is filled with complete epochs first; the rest is the prefix, in the order of
exponential keys -ln(u) / quality, whose sizes sum to what is missing. The last document of a prefix is taken in part.

Scale: one pass over the texts leaves a narrow table of (id, source, size, key). The place where a prefix ends is found by
histograms of the keys, 256 cells a level and three levels deep, so that no task ever sorts a whole source: only the rows of
the one cell in 2^24 that the end falls into are sorted.

Edge cases: null or blank texts have size 0 and take 0; a null source is a source of its own, last in the order; equal keys are
ordered by the id, then by the text's hash; repeated rows are documents of their own; an empty table gives an empty result; further columns
are ignored, or carried in one struct, so their names can't clash. Targets are computed on one row a source, in one task: sources are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, boxed, small, written

LEVELS = (16, 8, 0)
CELLS = 1 << 24


def text_quality(text: Column) -> Column:
    """A quality weight from 0.25 to 1: the share of letters, of any script, among a text's characters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.coalesce(F.lit(0.25) + F.lit(0.75) * letters / F.greatest(F.length(text), F.lit(1)), F.lit(1.0))


def uniform(key: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 from 48 bits of a hash of `key`; the same on every run."""
    bits = F.conv(F.substring(F.sha1(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 48)


def targets(items: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, target): the shares of the sum of sizes, capped and reshared. Runs on one row a source."""
    every, order = Window.partitionBy(), Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    per = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1).cast("long"))
    # Capped sources are a prefix by size / weight: with that prefix at its caps, the rest shares what is left by weight.
    by_ratio = Window.partitionBy().orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("left", F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(by_ratio), F.lit(0)))
    per = per.withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0)))
    per = per.withColumn("rate", F.col("left") / F.col("w_left").cast("double"))
    rate = F.min(F.when(F.col("rate") * F.col("w") <= cap * F.col("source_size"), F.struct(F.col("source_size") / F.col("w"), "rate"))).over(every)["rate"]
    target = F.least(F.lit(float(cap)) * F.col("source_size"), F.coalesce(rate, F.lit(0.0)) * F.col("w"))
    return per.select("source", "source_size", F.round(target, 6).alias("target"))


def mix(items: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """`items` has columns id, source, size (long) and weight (double, > 0). Adds source_size, target, taken and es_key.

    A `tie` column, if there, orders rows that agree in key and id.
    """
    if "tie" not in items.columns:
        items = items.withColumn("tie", F.lit(0))
    key = -F.log(uniform(F.col("id"), seed)) / F.greatest(F.col("weight"), F.lit(1e-9))
    items = items.withColumn("es_key", key).withColumn("cell", F.least(F.floor(F.col("es_key") / (1 + F.col("es_key")) * CELLS), F.lit(CELLS - 1)).cast("long"))
    items = written(items, "mix-items")
    goal = targets(items, weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    goal = written(goal, "mix-targets")
    # The cell where each source's prefix ends, level by level.
    end = goal.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for shift in LEVELS:
        inside = F.shiftright("cell", shift + 8) == F.col("prefix")
        cells = items.join(small(end), F.col("source").eqNullSafe(F.col("s")) & inside)
        hist = cells.groupBy("s", "rest", "before", F.shiftright("cell", shift).alias("c")).agg(F.sum("size").alias("n"))
        below = F.sum("n").over(Window.partitionBy("s").orderBy("c")) - F.col("n")
        hist = hist.withColumn("low", F.col("before") + below).where((F.col("low") <= F.col("rest")) & (F.col("low") + F.col("n") > F.col("rest")))
        end = written(hist.select("s", "rest", F.col("c").alias("prefix"), F.col("low").alias("before")), "mix-end")
    goal = goal.withColumnRenamed("source", "g").join(end.drop("rest"), F.col("g").eqNullSafe(F.col("s")), "left").drop("s")
    goal = small(written(goal, "mix-goal"))
    rows = items.join(goal, F.col("source").eqNullSafe(F.col("g"))).drop("g")
    at = F.col("cell") == F.col("prefix")
    rows_at = rows.where(at)
    order = Window.partitionBy("source").orderBy("es_key", "id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    sofar = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    rows_at = rows_at.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - sofar)))
    others = rows.where(~F.coalesce(at, F.lit(False))).withColumn("extra", F.when(F.col("cell") < F.col("prefix"), F.col("size")).otherwise(F.lit(0)))
    both = others.unionByName(rows_at)
    return both.withColumn("taken", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long")).drop("cell", "prefix", "before", "epochs", "rest", "extra", "weight")


def document_items(docs: DataFrame, weight: Column | None = None, payload: bool = False) -> DataFrame:
    """The items of a documents table: size in words, quality weight from the text unless given; with `payload`, its columns go along as one, `row`."""
    text = F.col("text")
    return docs.select(
        *([boxed(docs).alias("row")] if payload else []),
        F.col("doc_id").alias("id"), "source", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (text_quality(text) if weight is None else weight).alias("weight"), F.xxhash64(text).alias("tie"),
    )
