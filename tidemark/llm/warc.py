r"""WARC archives: writing with revisits, segments and chunked transfer framing, and reading with reassembly.

Writing: payloads of at least `min_revisit` bytes that are equal (by SHA-1) are stored once, by the row with the largest key; the others
become revisit records. A response's block is an HTTP message in chunked framing; a block longer than `segment_bytes` is split into a first
record and continuation records that name it as their origin, numbered from 1, the last with the total length. Archives are gzipped
text of Spark's own writer with the record terminator as line separator, so they go wherever Spark can write, one file a task.

Reading: records are split at version lines. In what is written here none stands in a block: one within a payload gets a chunk boundary
inside it, and no chunk or segment ends where its line break would complete one. Other writers' blocks may hold some: a piece without a
record's fields goes back to the block before it while that is short of its Content-Length (not if a split of a plain file starts between
them, nor if the piece looks like a record of its own). Then fields are parsed, continuation records are grouped by their origin's id, put in order
by segment number, checked for gaps and for the total length, joined, and decoded from chunked framing. Revisits get their
payload's length and digest from the record they refer to.

Scale: one shuffle of payloads by digest for writing, one of the segmented records alone for reading; groups are one payload's
segments, whatever the number of copies. No file is held whole.

Edge cases: a null payload is an empty one; null keys are kept as null; rows that repeat a key and a payload are all responses (or all
revisits), equal in every field; a broken or incomplete record keeps its row with a null payload and a message in `error`; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import written

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
#: No match of this that fails holds the start of another, so a reader that cannot step back over its buffer misses none, as it would with END before VERSION.
SEPARATOR = b"\r\n" + VERSION
LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
CHUNK = 8192
RECORD = "record_id string, type string, key string, uri string, refers_to string, origin string, segment int, total long, payload binary, payload_bytes long, payload_digest string, error string"
NAMES = [x.split()[0] for x in RECORD.split(", ")]
TYPES = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing, with a boundary inside every version line that the payload holds or a chunk's end would make, so no block can look like a record's start."""
    pieces = payload.split(VERSION)
    parts = [(VERSION[2:] if i else b"") + p + (VERSION[:2] if i < len(pieces) - 1 else b"") for i, p in enumerate(pieces)]
    cut = [c for p in parts for i in range(0, len(p), size) if (c := p[i : i + size])]
    out = [b"%x\r\n%b\r\n" % (len(c), c) for x in cut for c in ((x[:-1], x[-1:]) if x.endswith(VERSION[:-2]) else (x,))]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if it is cut or malformed."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut")
        out.append(body[at : at + n])
        at += n + 2


def record(kind: str, record_id: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", "1970-01-01T00:00:00Z"), *fields, ("Content-Length", len(block))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block


def response_records(record_id: str, fields: list[tuple[str, object]], payload: bytes, segment_bytes: int):
    """The response record of a payload, or its first segment and continuation records."""
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields = [*fields, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment_bytes:
        yield record("response", record_id, fields, block)
        return
    i = at = 0
    while at < len(block):
        part = block[at : at + segment_bytes]
        if part.endswith(VERSION[:-2]):  # with the terminator it would make a version line
            part = part[:-1]
        at += len(part)
        if i == 0:
            yield record("response", record_id, [*fields, ("WARC-Segment-Number", 1)], part)
        else:
            own = [("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", i + 1), ("WARC-Segment-Total-Length", len(block) if at == len(block) else None)]
            yield record("continuation", f"{record_id[:-1]}:{i + 1}>", own, part)
        i += 1


def write_archives(rows: DataFrame, path: str, min_revisit: int = 1000, segment_bytes: int = 16_384) -> None:
    """Write `rows` (key, uri, payload binary) as WARC files below `path`."""
    rows = rows.select("key", "uri", F.coalesce("payload", F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    first = rows.where(F.col("n") >= min_revisit).groupBy("digest").agg(F.max("key").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # A digest of a short payload never joins, so short equal payloads do not meet in one task.
    rows = rows.withColumn("long_digest", F.when(F.col("n") >= min_revisit, F.col("digest")))
    short, long = rows.where(F.col("long_digest").isNull()).withColumn("first", F.lit(None).cast(rows.schema["key"].dataType)), rows.where(F.col("long_digest").isNotNull()).join(first, "digest", "left")
    urn = lambda key: F.concat(F.lit("<urn:tidemark:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(">"))
    plan = short.unionByName(long).select(
        F.col("key").cast("string").alias("key"), F.regexp_replace("uri", "[\\r\\n]", "").alias("uri"), "digest", urn(F.col("key")).alias("id"),
        F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("key")), urn(F.col("first"))).alias("to"), "payload",
    )
    plan = plan.withColumn("payload", F.when(F.col("to").isNull(), F.col("payload")))

    def records(batches):
        for batch in batches:
            out, size = [], 0
            for r in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                fields = [("WARC-Target-URI", r["uri"]), ("Tidemark-Key", r["key"]), ("WARC-Payload-Digest", f"sha1:{digest}")]
                if r["to"] is None:
                    out += response_records(r["id"], fields, r["payload"], segment_bytes)
                else:
                    fields += [("WARC-Refers-To", r["to"]), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http;msgtype=response")]
                    out.append(record("revisit", r["id"], fields, HTTP + b"\r\n"))
                size += len(out[-1])
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = plan.mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def _decoded(block: bytes) -> tuple[bytes | None, int | None, str | None, str | None]:
    """(payload, its length, its digest, error) of an HTTP message."""
    try:
        head, sep, body = block.partition(END)
        if not sep:
            raise ValueError("no end of the HTTP header")
        if b"transfer-encoding: chunked" in head.lower():
            body = dechunked(body)
        return body, len(body), hashlib.sha1(body).hexdigest(), None
    except ValueError as e:
        return None, None, None, str(e)


def _whole(pieces):
    """Records from what stands between separators, (file, whether the file goes on behind this split, bytes): a piece without a record's fields is part
    of the block before it, if that is short of its Content-Length. The first half of the terminator, which the separator left, goes."""
    held, short, of, on = [], 0, None, False

    def joined(followed):
        value = SEPARATOR.join(held)
        return value.removesuffix(b"\r\n") if followed else value

    for file, more, piece in pieces:
        end = piece.find(END)
        head = b"\r\n" + piece[: max(0, end)].lower()
        if short > 0 and file == of and b"\r\nwarc-record-id:" not in head:
            held.append(piece)
            short -= len(SEPARATOR) + len(piece)
            continue
        if any(held):
            yield joined(file == of or on)
        length = LENGTH.search(head)
        held, short, of, on = [piece], end + len(END) + int(length[1]) - len(piece) if length else 0, file, more
    if any(held):
        yield joined(on)


def _parsed(value: bytes, payloads: bool) -> tuple:
    head, sep, block = value.removeprefix(VERSION).partition(END)
    f = {}
    for line in head.split(b"\r\n"):
        k, _, v = line.partition(b":")
        f[k.strip().lower()] = v.strip().decode("utf-8", "replace")
    get = lambda k: f.get(k.encode())
    number = lambda k: int(get(k)) if (get(k) or "").isdigit() else None
    if (n := number("content-length")) is not None and block[n:] in (END, b""):
        block = block[:n]
    error = None if sep and n == len(block) else "the block's length differs from Content-Length"
    segment, kind = number("warc-segment-number"), get("warc-type")
    payload = size = digest = None
    if error is None and segment is None and kind == "response":
        payload, size, digest, error = _decoded(block)
        payload = payload if payloads else None
    elif segment is not None:
        payload = block
    origin = get("warc-segment-origin-id") or (get("warc-record-id") if segment is not None else None)
    return get("warc-record-id"), kind, get("tidemark-key"), get("warc-target-uri"), get("warc-refers-to"), origin, segment, number("warc-segment-total-length"), payload, size, digest, error


def _batch(rows: list[tuple], types: list = TYPES, names: list[str] = NAMES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types, strict=True)], names)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each response and revisit: record_id, type, key, uri, refers_to (the key), payload, payload_bytes, payload_digest, error.

    With `payloads` false, `payload` is null, and lengths and digests are still those of whole payloads.
    """
    lines = spark.read.option("lineSep", SEPARATOR.decode()).text(path)
    more = F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length") < F.col("_metadata.file_size")
    lines = lines.select(F.col("_metadata.file_path").alias("file"), more.alias("more"), F.col("value").cast("binary").alias("value"))

    def parse(batches):
        whole = _whole(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        while rows := [_parsed(v, payloads) for v in itertools.islice(whole, 1000)]:
            yield _batch(rows)

    parsed = written(lines.mapInArrow(parse, RECORD), "warc-records")
    whole = parsed.where("segment is null and type in ('response', 'revisit')").drop("origin", "segment", "total")
    parts = parsed.where("segment is not null").groupBy("origin").agg(
        F.array_sort(F.collect_set(F.struct("segment", "payload"))).alias("parts"), F.max("total").alias("total"), F.count(F.when(F.col("segment") == 1, 1)).alias("copies"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("key", "uri", "type")], F.max("error").alias("error"),
    )
    joined = parts.withColumn("block", F.array_join(F.transform("parts", lambda p: p["payload"].cast("string")), "").cast("binary"))
    gap = ~F.coalesce(F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts")), F.lit(False))
    fault = F.coalesce("error", F.when(gap, "a segment is missing"), F.when(~F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False)), "the total length differs"))
    joined = joined.select("origin", "type", "key", "uri", "block", fault.alias("error"), F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)).cast("int"))).alias("copy"))

    def decode(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                payload, size, digest, error = _decoded(r["block"]) if r["error"] is None else (None, None, None, r["error"])
                out.append((r["origin"], r["type"], r["key"], r["uri"], None, payload if payloads else None, size, digest, error))
            yield _batch(out, [TYPES[i] for i in keep], [NAMES[i] for i in keep])

    keep = [i for i, n in enumerate(NAMES) if n not in ("origin", "segment", "total")]
    whole = whole.unionByName(joined.mapInArrow(decode, ", ".join(RECORD.split(", ")[i] for i in keep)))
    revisits, responses = whole.where("type = 'revisit'"), whole.where("type <> 'revisit'")
    to = responses.groupBy(F.col("record_id").alias("refers_to")).agg(F.max("key").alias("to_key"), F.max("payload_bytes").alias("to_bytes"), F.max("payload_digest").alias("to_digest"))
    resolved = revisits.join(to, "refers_to", "left").select(
        "record_id", "type", "key", "uri", F.col("to_key").alias("refers_to"), "payload", F.col("to_bytes").alias("payload_bytes"), F.col("to_digest").alias("payload_digest"),
        F.coalesce("error", F.when(F.col("to_bytes").isNull(), "the record it refers to is missing")).alias("error"),
    )
    return responses.unionByName(resolved)
