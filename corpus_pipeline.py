"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, mixing; each stage's result is a written table.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents.
Decisions are about rows: a row is known by its doc_id and a hash of its text, so a null or repeated doc_id says nothing about other rows.
Rows that agree in both are decided alike, but where one of a group stays: there one of them does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, mixing, neardup, quality, substrings
from tidemark.llm.common import boxed, discard, free_shuffles, fresh, held_out, small, text_key, unboxed, written


def _chosen(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """`docs` with ("left_semi") or without ("left_anti") those named in `rows` (doc_id, text_key)."""
    d, k = fresh(docs, "gone_id"), fresh(docs, "gone_key")
    rows = small(rows.select(F.col("doc_id").alias(d), F.col("text_key").alias(k)))
    return docs.join(rows, F.col("doc_id").eqNullSafe(F.col(d)) & (text_key(F.col("text")) == F.col(k)), how)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more; it learns from `labels` as op7 does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)), "quality")
    into = fresh(docs, "quality_score")
    return quality.score(docs, model, into).where(F.col(into) >= 0.3).drop(into)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): that with the smallest doc_id (null last), then the
    smallest text hash; of rows that agree in both, that with the smallest other columns. Texts without words are in no group and stay."""
    found = written(neardup.near_duplicates(docs, words=5, percent=80).where("root is not null").select("doc_id", "text_key", "root"), "groups")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("best"), F.count("*").alias("n"))
    best = written(best.where("n > 1").select("root", F.col("best.doc_id").alias("b"), F.col("best.text_key").alias("bk")), "best")
    grouped = found.join(best, "root")
    ours = F.col("doc_id").eqNullSafe(F.col("b")) & (F.col("text_key") == F.col("bk"))
    gone = written(grouped.where(~ours).select("doc_id", "text_key").distinct(), "gone")
    again = written(grouped.where(ours).groupBy("doc_id", "text_key").count().where("count > 1").drop("count"), "again")
    discard(found)
    free_shuffles(spark)
    kept = _chosen(docs, gone, "left_anti")
    if again.isEmpty():
        return kept
    several = _chosen(docs, again, "left_semi")
    one = several.groupBy("doc_id", text_key(F.col("text"))).agg(F.min(boxed(docs)).alias("row")).select(*unboxed("row", docs.columns))
    return _chosen(kept, again, "left_anti").unionByName(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words or more that a document with a smaller doc_id holds; documents left without a word go."""
    own = {c: fresh(docs, f"input_{c}") for c in docs.columns if c.lower() in ("n_words", "n_removed", "kept_text")}
    cut = substrings.without_repeats(docs.withColumnsRenamed(own), window=13).where("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.select(*[new.get(c, F.col(f"`{own.get(c, c)}`")).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no 10 words in a row (and no whole shorter item) with the benchmark."""
    hits = decontam.decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return _chosen(docs, written(hits.where(F.size("hit_words") > 0).select("doc_id", "text_key").distinct(), "leaks"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of which a word is taken, a row each, with size, source_size, target and taken (words, repeats counted) in place of columns so named."""
    added = ["size", "source_size", "target", "taken"]
    mixed = mixing.mix(mixing.document_items(docs, payload=True)).where("taken > 0")
    return mixed.select(*unboxed("row", [c for c in docs.columns if c.lower() not in added]), *added)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
]

#: The classifier is learned, which SQL cannot express; tests hold the later stages against brute force, and the first against labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
