"""Blocks of web pages, and entries: a bold header with the blocks up to the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ord, text, header): paragraphs, list items and headings in order; `header` marks headings and paragraphs that are bold throughout.

    Scripts, styles and comments go first, since their bodies may hold tags. A null page has no blocks.
    """
    clean = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    found = F.regexp_extract_all(clean, F.lit(r"(?is)(<(?:p|li|h[1-6])\b[^>]*>.*?(?=</?(?:p|li|h[1-6]|ul|ol|div)\b|\z))"), 1)
    raw = pages.select(key, F.posexplode(found).alias("ord", "raw"))
    text = F.regexp_replace(F.col("raw"), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    bold = F.col("raw").rlike(r"(?is)^<h[1-6]") | F.col("raw").rlike(r"(?is)^<p\b[^>]*>\s*<(b|strong)\b[^>]*>[^<]*</\1>\s*$")
    return raw.select(key, "ord", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"), bold.alias("header")).where("text <> ''")


def entries(found: DataFrame, key: str) -> DataFrame:
    """(key, entry, header, body): blocks before a page's first header are dropped; a page's blocks are the unit, never the table."""
    number = F.sum(F.col("header").cast("int")).over(Window.partitionBy(key).orderBy("ord"))
    rows = found.withColumn("entry", number).where("entry > 0")
    grouped = rows.groupBy(key, "entry").agg(F.max(F.when(F.col("header"), F.col("text"))).alias("header"), F.array_sort(F.collect_list(F.when(~F.col("header"), F.struct("ord", "text")))).alias("b"))
    return grouped.select(key, F.col("entry").cast("int").alias("entry"), "header", F.col("b.text").alias("body"))
