"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long): root is the smallest node of its component.

    Each round joins edges with the least neighbour of one end; a node's neighbours are never gathered. Rounds grow with the
    logarithm of the longest path; each is written to the shared folder.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges, before = written(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state == before:
            break
        before = state
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()
        edges, old = written(small, "edges"), edges
        discard(old)
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(edges.select("lo", "lo").distinct())
