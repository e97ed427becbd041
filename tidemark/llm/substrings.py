r"""Substring dedup by recompression: long repeats across documents are found through names that equal substrings share.

Words are symbols. First runs of one symbol become new symbols, then, in each round, do pairs (a, b) with a in the left and b in the right
half of a partition of all symbols. A symbol's name is a 64-bit hash of what it stands for and of the round, and the partition is a bit of the
name, so naming is global: the same text gets the same symbols in every document and task, but for the borders. How far a
symbol's forming looked to its left and right is kept with it (its context): every occurrence of a text that holds a symbol's whole
context has that symbol at the same place.

High level: rounds of runs and pairs go on until a text is one symbol. A symbol of two windows or more that also occurs in a document with a
smaller id is a verified repeat (equal names are equal texts), and every window within it is done: it is covered, and it is nobody's first
occurrence. As symbols of all levels take part, a whole copy is one span, and of a long passage only windows near its ends are left.
Low level, for the ends of repeats: after `ROUNDS` rounds, Spark finds the symbols whose contexts occur in two or more documents. A window that occurs in
two documents has, in both, the same symbols among those whose context it holds; so one whose inner symbol (that with the shortest context) has a
context that one document alone holds occurs nowhere else. What is left are windows whose inner symbol is shared, and the few without any; their hashes are joined, and
a window's words go where the same hash starts in a document with a smaller id.

Scale: passes over the texts for each level and shuffles of symbols (about a sixth of the words) and of the windows left; counts are partial
before they are shuffled, so frequent words, lines and passages cost a row a task. Joins on symbols and windows are skew-splittable;
no document's partners are ever gathered.

Edge cases: null and blank texts have no words and lose none; texts shorter than a window are kept as they are, up to white space; windows are
judged on the input, so a chain of copies loses all but the first; rows that repeat a doc_id count as one document, so neither removes the
other's words, but each text is cut at its own places (its hash, the tag, goes with every place); rows with a null doc_id neither lose words nor
take others'; input columns of any name pass through, but n_words, n_removed and kept_text are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import boxed, discard, free_shuffles, short_batches, small, small_lists, text_key, unboxed, written

ROUNDS, MOST_ROUNDS = 3, 60
#: A place in a document is tag * 2^30 + the word's number: a text is below 2 GB, so it has no more words. The tag is 0 but for doc_ids with several texts: there
#: it has 33 bits of the text's hash.
PLACE = 30
_U = np.uint64


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of two numbers, vectorised."""
    x = (a ^ (np.asarray(b, _U) * _U(0x9E3779B97F4A7C15))) * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(31)
    x = (x + np.asarray(b, _U)) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(29))


class Texts:
    """The word hashes of many texts in one array, with a border symbol of its own kind before, between and after them."""

    def __init__(self, texts: list[list[bytes]]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(np.r_[1, self.size + 1])[: len(texts)]
        self.h = np.empty(int((self.size + 1).sum()) + 1, _U)
        self.owner = np.full(len(self.h), -1, np.int64)
        borders = np.r_[0, self.start + self.size]
        self.h[borders] = mixed(np.arange(len(borders)).astype(_U), 77)
        for i, t in enumerate(texts):
            at = slice(self.start[i], self.start[i] + self.size[i])
            self.h[at] = np.fromiter(map(xxhash.xxh3_64_intdigest, t), _U, len(t))
            self.owner[at] = i


def recompressed(name: np.ndarray, owner: np.ndarray, rounds: int) -> tuple[np.ndarray, ...]:
    """(name, start, end, context start, context end) of the symbols that each round forms; ends are exclusive. Borders (owner -1) join nothing."""
    n, found = len(name), []
    # Runs: a maximal run becomes one symbol. That a symbol is no longer a run shows in its neighbours, which are its context.
    first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    last = np.r_[first[1:], n] - 1
    fresh = last > first
    name = np.where(fresh, mixed(mixed(name[first], (last - first + 1).astype(_U)), 2), name[first])
    start, left, right = first, np.maximum(first - 1, 0), np.minimum(last + 2, n)
    for r in range(1, rounds + 1):
        # Pairs: a symbol of the left half joins a following one of the right half. One that stays alone has looked that way.
        side = (mixed(name, 1000 + r) >> _U(60)) & _U(1) == 0
        text = owner[start] >= 0
        joins = np.r_[side[:-1] & ~side[1:] & text[:-1] & text[1:], False]
        if r == 1:
            found.append([x[fresh] for x in (name, start, np.r_[start[1:], n], left, right)])
        after_left, after_right = np.r_[left[1:], left[-1:]], np.r_[right[1:], right[-1:]]
        before_left, before_right = np.r_[left[:1], left[:-1]], np.r_[right[:1], right[:-1]]
        left, right = np.minimum(left, np.where(side, after_left, before_left)), np.maximum(right, np.where(side, after_right, before_right))
        at = np.flatnonzero(joins)
        name = name.copy()
        name[at] = mixed(mixed(name[at], name[at + 1]), 2 * r + 1)
        keep = ~np.r_[False, joins[:-1]]
        name, start, left, right, fresh = (x[keep] for x in (name, start, left, right, joins))
        found.append([x[fresh] for x in (name, start, np.r_[start[1:], n], left, right)])
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def passages(t: Texts, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, starts, ends) of the symbols of two windows' length or more, of all levels: each is reported in the round that forms it."""
    name, start, found = t.h, np.arange(len(t.h)), []
    for r in range(1, MOST_ROUNDS):
        first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        length = np.diff(np.r_[first, len(name)])
        fresh = length > 1
        name, start = np.where(fresh, mixed(mixed(name[first], length.astype(_U)), 2 * r), name[first]), start[first]
        side, text = (mixed(name, 1000 + r) >> _U(60)) & _U(1) == 0, t.owner[start] >= 0
        joins = np.r_[side[:-1] & ~side[1:] & text[:-1] & text[1:], False]
        name = np.where(joins, mixed(mixed(name, np.r_[name[1:], name[:1]]), 2 * r + 1), name)
        keep = ~np.r_[False, joins[:-1]]
        name, start, fresh = name[keep], start[keep], (fresh | joins)[keep]
        end = np.r_[start[1:], len(t.h)]
        ok = fresh & (end - start >= 2 * window) & (t.owner[start] >= 0)
        found.append((name[ok], start[ok], end[ok]))
        if len(name) <= 2 * len(t.size) + 1:  # each text is one symbol
            break
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def inside(t: Texts, first: list, end: list, window: int) -> np.ndarray:
    """Mask of the starts of windows that lie within one of each text's spans."""
    mark = np.zeros(len(t.h) + 1, np.int64)
    for i, (a, b) in enumerate(zip(first, end, strict=True)):
        if a is not None:
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            np.add.at(mark, t.start[i] + a, 1)
            np.add.at(mark, t.start[i] + b - window + 1, -1)
    return np.cumsum(mark)[:-1] > 0


def span_keys(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words h[first:end] of each span, from prefix sums of a polynomial modulo 2^64. Spans with equal words have equal keys."""
    base = 0x9E3779B97F4A7C15
    power, inverse = np.full(len(h), base, _U), np.full(len(h), pow(base, -1, 1 << 64), _U)
    power[0] = inverse[0] = 1
    power, inverse = np.cumprod(power), np.cumprod(inverse)
    sums = np.r_[_U(0), np.cumsum(h * power)]
    return mixed((sums[end] - sums[first]) * inverse[first], (end - first).astype(_U))


def inner(t: Texts, window: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, a start of a window of each, each window's symbol by number or -1, open starts).

    Of the symbols whose whole context a window holds, that with the shortest context (then that with the greatest key) stands for the window, as it
    stands for the most windows; symbols that stand for no window are left out. A symbol's key is a hash of its context's words, which every occurrence
    of the window holds too and fewer other texts share than the symbol. Open starts are those of windows that hold no context. Windows that
    start where `known` is true are left out.
    """
    _, start, end, left, right = recompressed(t.h, t.owner, ROUNDS)
    ok = (t.owner[left] >= 0) & (t.owner[left] == t.owner[right - 1]) & (right - left <= window) & (end - start > 1)
    left, right = left[ok], right[ok]
    name = span_keys(t.h, left, right)
    doc = t.owner[left]
    lo, hi = np.maximum(right - window, t.start[doc]), np.minimum(left, t.start[doc] + t.size[doc] - window)
    order = np.lexsort((name, left - right))
    order = order[(hi >= lo)[order]]
    name, lo, hi = name[order], lo[order], hi[order]
    width = hi - lo + 1
    at = np.repeat(lo - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
    # In ascending order, so that the last to be written to a window's start stands for it.
    symbol = np.full(len(t.h), -1, np.int64)
    symbol[at] = np.repeat(np.arange(len(name)), width)
    symbol[known] = -1
    chosen, place = np.unique(symbol[symbol >= 0], return_inverse=True)
    symbol[symbol >= 0] = place
    fits = (t.owner >= 0) & ~known
    fits[: len(fits) - window + 1] &= t.owner[: len(fits) - window + 1] == t.owner[window - 1 :]
    fits[len(fits) - window + 1 :] = False
    return name[chosen], lo[chosen], symbol, np.flatnonzero(fits & (symbol < 0))


def windows(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Hashes of the windows that start at `at`."""
    out = np.zeros(len(at), _U)
    for i in range(window):
        out = mixed(out, h[at + i])
    return out


def _batch(t: Texts, rows: pa.RecordBatch, name: np.ndarray, at: np.ndarray, open_window: bool, whole: bool = True) -> pa.RecordBatch:
    """Rows (name, doc_id, start, open) for symbols or windows at positions `at`; without `whole`, start has the tag alone."""
    doc = t.owner[at]
    start = (rows.column("tag").to_numpy()[doc] << PLACE) + (at - t.start[doc] if whole else 0)
    cols = [pa.array(name.view(np.int64)), rows.column("doc_id").take(pa.array(doc)), pa.array(start.astype(np.int64)), pa.array(np.full(len(at), open_window))]
    return pa.RecordBatch.from_arrays(cols, ["name", "doc_id", "start", "open"])


def _portions(batches, limit: int = 120_000):
    """Slices of the batches with about `limit` words, as (rows, words of each text)."""
    for b in batches:
        texts, first, total = [], 0, 0
        for i, x in enumerate(b.column("text")):
            texts.append((x.as_py() or "").encode().split())
            total += len(texts[-1])
            if total >= limit or i == len(b) - 1:
                yield b.slice(first, i + 1 - first), texts
                texts, first, total = [], i + 1, 0


def tagged(docs: DataFrame) -> DataFrame:
    """`docs` with the column tag."""
    several = written(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("again")), "several")
    if several.isEmpty():
        return docs.withColumn("tag", F.lit(0).cast("long"))
    tag = F.shiftrightunsigned(text_key(F.col("text")), PLACE + 1)
    return docs.join(small(several), F.col("doc_id") == F.col("again"), "left").withColumn("tag", F.when(F.col("again").isNotNull(), tag).otherwise(F.lit(0).cast("long"))).drop("again")


def repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, tag, span_first, span_end: arrays) of a frame with doc_id, text and tag: the words, from 0, that windows cover which also start in a
    document with a smaller doc_id. A written table."""
    docs = docs.select("doc_id", "text", "tag").where(F.col("doc_id").isNotNull())
    id_field = docs.schema["doc_id"].dataType.simpleString()
    schema = f"name long, doc_id {id_field}, start long, open boolean"
    tag, place = F.shiftright("start", PLACE).alias("tag"), F.col("start").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")

    def high(batches):
        for rows, texts in _portions(batches):
            t = Texts(texts)
            name, start, end = passages(t, window)
            b = _batch(t, rows, name, start, False)
            yield b.set_column(3, "end", pa.array((end - t.start[t.owner[start]]).astype(np.int32)))

    long = written(docs.mapInArrow(high, f"name long, doc_id {id_field}, start long, end int"), "passages")
    # Counts are mostly 1 and take less of a shuffle than a greatest doc_id; what one document repeats is counted too and joins with nothing.
    first = long.groupBy("name").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("name", "a")
    spans = long.join(first, "name").where("doc_id > a").groupBy("doc_id", tag).agg(F.array_sort(F.collect_set(F.struct(place.alias("start"), "end"))).alias("spans"))
    spans = written(spans.select("doc_id", "tag", F.col("spans.start").alias("span_first"), F.col("spans.end").alias("span_end")), "spans")
    discard(long)
    free_shuffles(docs.sparkSession)
    docs = docs.join(small_lists(spans, "span_first", "span_end"), ["doc_id", "tag"], "left")

    def symbols(batches):
        for rows, texts in _portions(batches):
            t = Texts(texts)
            done = inside(t, rows.column("span_first").to_pylist(), rows.column("span_end").to_pylist(), window)
            name, lo, _, free = inner(t, window, done)
            at = np.unique(mixed(name, t.owner[lo].astype(_U)), return_index=True)[1]
            yield _batch(t, rows, name[at], lo[at], False, whole=False)
            yield _batch(t, rows, windows(t.h, free, window), free, True)

    found = written(docs.mapInArrow(symbols, schema), "symbols")
    free_shuffles(docs.sparkSession)
    names = found.where("not open").select("name", "doc_id", tag)
    shared = names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    of_doc = names.join(shared, "name").groupBy("doc_id", "tag").agg(F.collect_list("name").alias("shared"))
    texts = docs.join(of_doc, ["doc_id", "tag"])

    def candidates(batches):
        for rows, texts in _portions(batches):
            t = Texts(texts)
            done = inside(t, rows.column("span_first").to_pylist(), rows.column("span_end").to_pylist(), window)
            name, lo, symbol, _ = inner(t, window, done)
            lists = rows.column("shared")
            values = lists.flatten().to_numpy().view(_U)
            whose = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            # A document's shared names, made distinct from other documents' by its place.
            ours = np.sort(mixed(values, whose.astype(_U)))
            asked = mixed(name, t.owner[lo].astype(_U))
            known = ours[np.minimum(np.searchsorted(ours, asked), len(ours) - 1)] == asked if len(ours) else np.zeros(len(asked), bool)
            at = np.flatnonzero(symbol >= 0)
            at = at[known[symbol[at]]]
            yield _batch(t, rows, windows(t.h, at, window), at, True)

    closed = written(texts.mapInArrow(candidates, schema), "windows")
    free_shuffles(docs.sparkSession)
    spots = closed.unionAll(found.where("open")).select(F.col("name").alias("hash"), "doc_id", "start")
    first = spots.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = spots.join(first, "hash").where("doc_id > first").groupBy("doc_id", tag).agg(F.array_sort(F.collect_set(place)).alias("starts"))
    # Starts that follow each other without a gap between their windows are one span.
    opens = F.filter(F.transform("starts", lambda x, i: F.when((i == 0) | (x > F.get(F.col("starts"), i - 1) + window), x)), lambda x: x.isNotNull())
    ends = F.filter(F.transform("starts", lambda x, i: F.when((i == F.size("starts") - 1) | (F.get(F.col("starts"), i + 1) > x + window), x + window)), lambda x: x.isNotNull())
    later = later.select("doc_id", "tag", opens.alias("span_first"), ends.alias("span_end"))
    both = later.unionByName(spans).groupBy("doc_id", "tag")
    out = written(both.agg(F.flatten(F.collect_list("span_first")).alias("span_first"), F.flatten(F.collect_list("span_end")).alias("span_end")), "repeats")
    for table in (found, closed, spans):
        discard(table)
    free_shuffles(docs.sparkSession)
    return out


def without_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """`docs` with n_words, n_removed and kept_text: the words of no repeated window, joined by single blanks (null for a null text)."""
    short_batches(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept_text")
    rows = tagged(docs.select("doc_id", "text", boxed(docs).alias("row")))
    found = repeats(rows, window)
    rows = rows.drop("text").join(small_lists(found, "span_first", "span_end"), ["doc_id", "tag"], "left").select("row", "span_first", "span_end")

    def cut(batches):
        for b in batches:
            total, removed, texts = [], [], []
            for t, first, end in zip(b.column("row").field("text").to_pylist(), b.column("span_first").to_pylist(), b.column("span_end").to_pylist(), strict=True):
                kept = words = (t or "").encode().split()
                if first is not None:
                    kept, at = [], 0
                    for a, z in sorted(zip(first, end, strict=True)):
                        kept += words[at:a]
                        at = max(at, z)
                    kept += words[at:]
                total.append(len(words))
                removed.append(len(words) - len(kept))
                texts.append(None if t is None else b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["row", "n_words", "n_removed", "kept_text"])

    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string("n_words long, n_removed long, kept_text string").fields])
    return rows.mapInArrow(cut, schema).select(*unboxed("row", docs.columns), "n_words", "n_removed", "kept_text")


def digest(texts: DataFrame) -> DataFrame:
    """The digest columns of `without_repeats`'s result."""
    return texts.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))

