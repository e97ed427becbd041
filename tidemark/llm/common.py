"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Broadcast a table only up to this many (narrow) rows; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000
#: Values of arrays in a broadcast table, and bytes of texts in a training sample, at most.
BROADCAST_VALUES, SAMPLE_BYTES = 4_000_000, 64 << 20
#: Rows of whole texts in an Arrow batch, at most.
ARROW_ROWS, BATCH_ROWS = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: ASCII white space, the separators of `[^\x20\x09-\x0D]+`; Python's bytes.split() has the same set.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the session's Arrow batches to `rows` rows (never raise them): batches of whole texts else take hundreds of MB of an executor."""
    if int(spark.conf.get(BATCH_ROWS)) > rows or int(spark.conf.get(BATCH_ROWS)) <= 0:
        spark.conf.set(BATCH_ROWS, rows)


def written(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage ends there, and a lost executor costs nothing.

    `group`: rows in a row group, at most, for rows of megabytes; a reader holds all of a group's (up to 4,096) at once.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    short_batches(spark)
    out = df.write.option("compression", "zstd")
    (out if group is None else out.option("parquet.block.row.count.limit", group)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that `written` made and that no later step reads."""
    spark = table.sparkSession
    for name in table.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps: executors keep them on disk until the driver has collected the frames that made them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` (rows of fixed width) marked for broadcast if a count shows that it is small enough, else `df` for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_lists(df: DataFrame, *lists: str, most: int = BROADCAST_VALUES) -> DataFrame:
    """As `small`, for rows that carry arrays: the values in them are counted too."""
    n = df.agg(F.sum(sum((F.coalesce(F.size(c), F.lit(0)) for c in lists), F.lit(1)))).first()[0] or 0
    return F.broadcast(df) if n <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with underscores after it until no column of `df` is called so, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def boxed(df: DataFrame) -> Column:
    """All columns of `df` as one struct, so that helper columns beside it can clash with none; `unboxed` takes them out again."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unboxed(row: str, columns: list[str]) -> list[Column]:
    return [F.col(row)[c].alias(c) for c in columns]


def text_key(text: Column) -> Column:
    """With a doc_id, the identity of a row whose doc_id may be null or repeated: a 64-bit hash of the text."""
    return F.xxhash64(text)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod `modulus` is `remainder`; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample_of(df: DataFrame, by: str, keys: list[str], rows: int, most_bytes: int = SAMPLE_BYTES) -> list:
    """[(text, value of `by`)] for at most `rows` distinct rows of `df` (`keys`: its columns, text among them), as even over the values as they allow.

    Rows are chosen by a hash of their whole content, so repeated ids don't come all or none and reruns choose the same. Every value that is not null gets one row
    at least, even where there are more values than `rows`. The others are taken in the order of their hashes; one that would make the sample longer than
    `most_bytes` is passed over.
    """
    df = df.where(F.col(by).isNotNull()).select(*keys, F.xxhash64(*keys, F.lit("sample")).alias("h"))
    counts = df.groupBy(by).agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("first")).collect()
    if not counts:
        return []
    counts.sort(key=lambda r: (r["n"], repr(r[by])))
    rates, quotas, left = [], {}, rows
    for i, r in enumerate(counts):  # rare values first; what they can't fill goes to the others
        quota = max(1, left // (len(counts) - i))
        left, quotas[r[by]] = max(0, left - min(quota, r["n"])), quota
        rates.append((r[by], int(min(1.0, 1.3 * quota / max(1, r["n"])) * 1_000_000), r["first"]))
    kind = df.schema[by].dataType.simpleString()
    rates = small(df.sparkSession.createDataFrame(rates, f"`{by}` {kind}, rate int, first long"))
    chosen = df.join(rates, by).where((F.col("h") == F.col("first")) | (F.pmod("h", F.lit(1_000_000)) < F.col("rate")))
    chosen = written(chosen.select(*keys, "h", (F.col("h") == F.col("first")).alias("due")).distinct(), "sample")
    keep, total = {}, 0
    for r in chosen.select("h", by, "due", F.octet_length("text").alias("n")).orderBy(F.desc("due"), "h").limit(4 * rows + len(counts)).collect():
        if r["due"] or (quotas[r[by]] > 0 and total + (r["n"] or 0) <= most_bytes):
            quotas[r[by]] -= 1
            total += r["n"] or 0
            keep[r["h"]] = r[by]
    last = max(keep)
    found = chosen.where((F.col("h") <= last) | F.col("due")).select("h", "text", by).toLocalIterator()
    out = sorted({(r["text"], r[by]) for r in found if r["h"] in keep}, key=repr)
    discard(chosen)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> list:
    """[(text, label)] of at most `rows` labelled documents, of either label as many where there are enough.

    Labels are sampled first, by a hash, so the join's broadcast side is bounded; what documents that repeat a doc_id add is sampled after the join.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    counts = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    rate = F.when(F.col("label") == 1, F.lit(4 * rows / max(1, counts.get(1, 0)))).otherwise(F.lit(4 * rows / max(1, counts.get(0, 0))))
    chosen = chosen.where(F.pmod(F.xxhash64("doc_id", F.lit("label")), F.lit(1_000_000)) < rate * 1_000_000)
    found = written(docs.select("doc_id", "text").join(small(chosen), "doc_id").select("text", "label"), "labelled")
    out = sample_of(found, "label", ["text", "label"], rows)
    discard(found)
    return out


def with_fields(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of `df` with further columns, for functions that append to Arrow batches."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in kinds.items())).fields])


def slices(texts: list[str | None], limit: int = 200_000):
    """(first, texts) with about `limit` characters at a time."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= limit or i == len(texts) - 1:
            yield first, texts[first : i + 1]
            first, total = i + 1, 0
