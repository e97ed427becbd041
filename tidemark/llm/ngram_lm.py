r"""Language-model scoring with a log-frequency Bloom filter.

Tokens are lower-cased words and one end token a text. Counts c of words and of word pairs are quantised to levels 1 + floor(log c) (base
1.5), and a key enters a Bloom filter once for each level up to its own; its count is read by probing level after level until one is
missing. A pair's probability is P(w|v) = (c(v w) + T(v) P(w)) / (c(v) + T(v)), where P(w) = (c(w) + 1) / (N + V + 1), T(v) = c(v)^b
stands for the number of different followers of v, and b makes a text of N tokens have as many different pairs as were counted. The word
before the first is the end token.

Beside it stands the exact add-one unigram score (`base_score`). Its counts come from a bounded table of the most frequent words, sent to all
workers, and for other words from a join with the full table.

Scale: counts are summed within a task's portion of texts, packed into binary rows by hash shard, and merged a shard a task; shards are sized
to a bounded share of the corpus. The pair filter grows with the corpus: up to `max_broadcast` bytes it is broadcast; beyond that it
stays in shards, a portion's tokens, summed by document and pair, are dealt to their pair's shard, and the partial sums of a document are
added up. Words outside the head go the same way. A shard that is asked more than `group_bytes` answers in several groups, each with a copy of
its filter, so a frequent pair or word is no one task's. No row is a single token on either way.
The word filter has the same bound: beyond it, portions are written with their tokens, their different words are asked of the word shards (which answer
with exact counts too), and the answers return to their portion by its number. Then nothing of the model is broadcast.

Edge cases: null and blank texts are the end token alone; with nothing learned, N = V = 0 and every token has probability 1; rows that repeat a
doc_id are scored each on its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import BROADCAST_ROWS, written
from tidemark.llm.substrings import mixed

BASE = 1.5
PROBES = 5
BITS = 9
SHARD_BYTES = 24 << 20
GROUP_BYTES = 64 << 20
HEAD_WORDS = 1 << 18
_U = np.uint64
END = xxhash.xxh3_64_intdigest(b" end")


def portions(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, token hashes, row number of each token) for about `limit` tokens at a time, from as many batches as that takes; a text's last token is the end token."""
    held, parts, total = [], [], 0

    def one() -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        rows = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return rows, np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])

    for b in batches:
        first = 0
        for i, x in enumerate(b.column("text")):
            words = (x.as_py() or "").encode().lower().split()
            h = np.empty(len(words) + 1, _U)
            h[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
            h[-1] = END
            parts.append(h)
            total += len(h)
            if total >= limit:
                held.append(b.slice(first, i + 1 - first))
                yield one()
                held, parts, total, first = [], [], 0, i + 1
        if first < len(b):
            held.append(b.slice(first))
    if held:
        yield one()


def pairs(h: np.ndarray) -> np.ndarray:
    """Keys of (previous token, token); every text ends with the end token, so the previous of a first one is the end token too."""
    return mixed(np.r_[_U(END), h[:-1]], 1) ^ mixed(h, 2)


def _packed(keys: np.ndarray, shards: int, narrow: bool, kind: int, found: list) -> None:
    """Rows (kind, shard, keys, counts) of the distinct keys; narrow keys keep their upper 32 bits, as the shard takes the lower ones."""
    keys, counts = np.unique(keys, return_counts=True)
    place = mixed(keys, 3) if not narrow else keys
    shard = (place % _U(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    present, first = np.unique(shard[order], return_index=True)
    for s, at in zip(present.tolist(), np.split(order, first[1:]), strict=True):
        k = (keys[at] >> _U(32)).astype(np.uint32) if narrow else keys[at]
        found.append((kind, s, k.tobytes(), counts[at].astype(np.uint32).tobytes()))


def _start(key32: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a key's probes for a level begin, and by what they go on."""
    x = mixed(key32.astype(_U) | _U(level << 32), 11)
    return x, ((x >> _U(17)) | _U(1)) * _U(0x9E3779B97F4A7C15)


def _position(start: np.ndarray, step: np.ndarray, probe: int, m: np.ndarray | int) -> np.ndarray:
    return (((start + _U(probe) * step) >> _U(32)) * np.asarray(m, _U)) >> _U(32)


def _merged(table: pa.Table) -> pa.Table:
    """One shard's counts summed, its filter bits, and for words the exact counts."""
    kind, shard = table["kind"][0].as_py(), table["shard"][0].as_py()
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint32 if kind else _U)
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint32).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    keys, counts = keys[first], np.add.reduceat(counts, first)
    levels = 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)
    m = max(64, BITS * int(levels.sum()))
    if m >= 1 << 32:
        raise ValueError("a shard's filter has too many bits; use more shards")
    bits = np.zeros(m, bool)
    key32 = keys if kind else (mixed(keys, 3) >> _U(32)).astype(np.uint32)
    for level in range(1, int(levels.max()) + 1):
        key32, levels = key32[levels >= level], levels[levels >= level]
        start, step = _start(key32, level)
        for p in range(PROBES):
            bits[_position(start, step, p, m)] = True
    row = {"kind": kind, "shard": shard, "m": m, "bits": np.packbits(bits, bitorder="little").tobytes(), "total": int(counts.sum()), "n_keys": len(keys)}
    row |= {"words": b"" if kind else keys.tobytes(), "counts": b"" if kind else counts.tobytes()}
    return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)})


class Filter:
    """Log-frequency Bloom filter in shards; `levels` reads quantised counts by repeated probes."""

    def __init__(self, shards: int, rows: list[dict]):
        self.shards, self.m, self.base = shards, np.ones(shards, _U), np.zeros(shards, _U)
        parts, at = [np.zeros(1, np.uint8)], 1
        for r in rows:
            self.m[r["shard"]], self.base[r["shard"]] = r["m"], at * 8
            parts.append(np.frombuffer(r["bits"], np.uint8))
            at += len(parts[-1])
        self.bytes = np.concatenate(parts)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        shard = (keys % _U(self.shards)).astype(np.int64)
        key32, m, base = keys >> _U(32), self.m[shard], self.base[shard]
        out, live, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        while len(live):
            level += 1
            start, step = _start(key32, level)
            for p in range(PROBES):
                at = _position(start, step, p, m) + base
                hit = (self.bytes[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1
                if not hit.all():
                    live, start, step, m, base, key32 = (x[hit] for x in (live, start, step, m, base, key32))
            out[live] = level
        return out


#: The mean of a level's counts, by level; level 0 is 0.
VALUES = np.r_[0.0, [(math.ceil(BASE**q - 1e-9) + max(math.ceil(BASE**q - 1e-9), math.ceil(BASE ** (q + 1) - 1e-9) - 1)) / 2 for q in range(120)]]


def pair_log10(together: np.ndarray, before: np.ndarray, single: np.ndarray, b: float) -> np.ndarray:
    """log10 P(w|v) from c(v w), c(v) and P(w)."""
    follow = before**b
    together = np.minimum(together, before)
    return np.log10(np.where(before > 0, (together + follow * single) / np.maximum(before + follow, 1e-300), single))


def learn(docs: DataFrame, shards: int) -> DataFrame:
    """The written shards (kind 0: words, 1: pairs) of a training frame with a text column."""

    def count(batches):
        for _, h, _ in portions(batches, 600_000):
            found: list[tuple] = []
            _packed(h, shards, False, 0, found)
            _packed(pairs(h), shards, True, 1, found)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "shard", "keys", "counts"])

    counted = docs.select("text").mapInArrow(count, "kind int, shard int, keys binary, counts binary")
    merged = counted.groupBy("kind", "shard").applyInArrow(_merged, "kind int, shard int, m long, bits binary, total long, n_keys long, words binary, counts binary")
    return written(merged, "lm-shards")


def _summed(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct (row, key), and how often it occurs."""
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])][: len(k)])
    return order[first], np.diff(np.r_[first, len(k)]).astype(np.uint32)


def dealt(packs: DataFrame, tables: DataFrame, group_bytes: int, shards: int = 1) -> tuple[DataFrame, DataFrame]:
    """Both with a `salt`: a shard's packs in groups of about `group_bytes` (a pack is never cut), and its row of `tables` once for each group."""
    length = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) for f in packs.schema if isinstance(f.dataType, T.BinaryType)), F.lit(0).cast("long"))
    salts = packs.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum(length) / group_bytes)).alias("salts"))
    if 2 * shards <= BROADCAST_ROWS:
        salts = F.broadcast(salts)
    salt = F.pmod(F.xxhash64(*packs.columns), F.col("salts")).alias("salt")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
    return packs.join(salts, "shard").select(*packs.columns, salt), tables.join(salts, "shard").select(*tables.columns, copies)


def _asked(shards: int):
    """Per portion: one row of its ids and tokens, and for each shard of words that occurs a row of the different words to ask it for."""

    def run(batches):
        for part, h, row in portions(batches, 200_000):
            rid = part.column("rid").to_numpy()
            distinct = np.unique(h)
            place = (mixed(distinct, 3) % _U(shards)).astype(np.int32)
            asks = [(int(s), distinct[place == s].tobytes()) for s in np.unique(place)]
            k, ids = len(asks), part.column("doc_id")
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)] + [len(ids)] * k, pa.int32()), ids)
            columns = [pa.array([int(rid[0])] * (k + 1), pa.int64()), pa.array([None] + [s for s, _ in asks], pa.int32()), pa.array([h.tobytes()] + [w for _, w in asks], pa.binary())]
            columns += [pa.array([x.tobytes()] + [None] * k, pa.binary()) for x in (rid.astype(np.int64), np.bincount(row, minlength=len(rid)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, lists], ["portion", "shard", "keys", "rids", "ns", "doc_ids"])

    return run


def _told(left: pa.Table, right: pa.Table) -> pa.Table:
    """A word shard's answers: for each of `left`'s rows of words their rough counts by the filter and their exact ones."""
    out = []
    if len(left) and len(right):
        row = right.slice(0, 1).to_pylist()[0]
        own = Filter(1, [{"shard": 0, "m": row["m"], "bits": row["bits"]}])
        w, c = np.frombuffer(row["words"], _U), np.frombuffer(row["counts"], np.int64)
    for keys in left["keys"].to_pylist() if len(left) else []:
        k = np.frombuffer(keys, _U)
        rough, exact = np.zeros(len(k)), np.zeros(len(k), np.int64)
        if len(right):
            i = np.minimum(np.searchsorted(w, k), len(w) - 1)
            rough, exact = VALUES[own.levels(mixed(k, 3))], np.where(w[i] == k, c[i], 0)
        out.append((rough.tobytes(), exact.tobytes()))
    return pa.table({"portion": left["portion"] if len(left) else pa.array([], pa.int64()), "keys": left["keys"] if len(left) else pa.array([], pa.binary()), "rough": pa.array([r for r, _ in out], pa.binary()), "exact": pa.array([e for _, e in out], pa.binary())})


def _head(shards: int):
    def run(batches):
        for b in batches:
            for words, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w, c = np.frombuffer(words, _U), np.frombuffer(counts, np.int64)
                at = np.argsort(-c, kind="stable")[: -(-HEAD_WORDS // shards)]
                yield pa.RecordBatch.from_arrays([pa.array([w[at].tobytes()], pa.binary()), pa.array([c[at].tobytes()], pa.binary())], ["words", "counts"])

    return run


def score(docs: DataFrame, training: Column, max_broadcast: int = 256 << 20, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs`, learning from those where `training` holds."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(12, -(-size // SHARD_BYTES))
    table = learn(docs.where(training), shards)
    sums = {r["kind"]: r for r in table.groupBy("kind").agg(F.sum("total").alias("total"), F.sum("n_keys").alias("n_keys"), F.sum(F.octet_length("bits")).alias("bytes")).collect()}
    tokens, vocabulary = (sums[0]["total"], sums[0]["n_keys"]) if sums else (0, 0)
    b = min(1.0, math.log(max(2, sums[1]["n_keys"])) / math.log(max(3, tokens))) if sums else 1.0
    words_local = not sums or sums[0]["bytes"] <= max_broadcast
    local = words_local and (not sums or sums[1]["bytes"] <= max_broadcast)
    sent = "true" if local else "kind = 0" if words_local else "false"
    rows = table.where(sent).select("kind", "shard", "m", "bits").toArrow().to_pylist()
    filters = [Filter(shards, [r for r in rows if r["kind"] == k]) for k in (0, 1)]
    del rows
    heads = table.where("kind = 0" if words_local else "false").select("words", "counts").mapInArrow(_head(shards), "words binary, counts binary").toArrow()
    words = np.frombuffer(b"".join(heads["words"].to_pylist()), _U)
    order = np.argsort(words)
    head = (words[order], np.frombuffer(b"".join(heads["counts"].to_pylist()), np.int64)[order])
    shared = spark.sparkContext.broadcast((filters, head))
    del filters
    below = math.log10(tokens + vocabulary + 1)
    names = ["rid", "doc_id", "n_tokens", "n_known", "base_score", "score", "shard", "keys", "rids", "befores", "singles", "ns"]
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"rid long, doc_id {id_type}, n_tokens long, n_known long, base_score double, score double, shard int, keys binary, rids binary, befores binary, singles binary, ns binary"

    def scored(doc_ids: pa.Array, rid: np.ndarray, h: np.ndarray, row: np.ndarray, distinct: np.ndarray, at: np.ndarray, rough: np.ndarray, exact: np.ndarray) -> pa.RecordBatch:
        """A portion's rows and packs; `rough` and `exact` are the counts of its `distinct` words, exact ones -1 where they are still to be asked for."""
        n = len(rid)
        single, before = (rough[at] + 1) / 10**below, np.r_[rough[np.searchsorted(distinct, _U(END))], rough[at][:-1]]
        seen = exact[at] >= 0
        base = np.bincount(row, np.where(seen, np.log10(np.maximum(exact[at], 0) + 1), 0.0), n) - below * np.bincount(row, minlength=n)
        packs: list[tuple] = []
        key = pairs(h)
        if local:
            total = np.bincount(row, pair_log10(VALUES[shared.value[0][1].levels(key)], before, single, b), n)
        else:
            total = np.zeros(n)
            one, times = _summed(key, row)
            place = (key[one] % _U(shards)).astype(np.int32)
            for s in np.unique(place):
                m = one[place == s]
                packs.append((shards + int(s), (key[m] >> _U(32)).tobytes(), rid[row[m]].tobytes(), before[m].tobytes(), single[m].tobytes(), times[place == s].tobytes()))
        rare, owner = h[~seen], row[~seen]
        one, times = _summed(rare, owner)
        rare, owner = rare[one], owner[one]
        place = (mixed(rare, 3) % _U(shards)).astype(np.int32)
        for s in np.unique(place):
            m = place == s
            packs.append((int(s), rare[m].tobytes(), rid[owner[m]].tobytes(), None, None, times[m].tobytes()))
        k = len(packs)
        gap = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(k, kind)])
        full = [pa.concat_arrays([pa.nulls(n, t), pa.array([p[j] for p in packs], t)]) for j, t in enumerate((pa.int32(), *[pa.binary()] * 5))]
        ids = pa.concat_arrays([doc_ids, pa.nulls(k, doc_ids.type)])
        return pa.RecordBatch.from_arrays([gap(rid, pa.int64()), ids, gap(np.bincount(row, minlength=n), pa.int64()), gap(np.bincount(row, exact[at] > 0, n).astype(np.int64), pa.int64()), gap(base, pa.float64()), gap(total, pa.float64()), *full], names)

    def run(batches):
        (of_word, _), (known, counts) = shared.value
        for part, h, row in portions(batches, 200_000):
            distinct, at = np.unique(h, return_inverse=True)
            i = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
            exact = np.where(known[i] == distinct, counts[i], -1) if len(known) else np.full(len(distinct), -1)
            yield scored(part.column("doc_id"), part.column("rid").to_numpy(), h, row, distinct, at, VALUES[of_word.levels(mixed(distinct, 3))], exact)

    def run_told(left: pa.Table, right: pa.Table) -> pa.Table:
        """As `run`, for a written portion and the answers about its words."""
        h, rid, lengths = (np.frombuffer(left[c][0].as_py(), kind) for c, kind in (("keys", _U), ("rids", np.int64), ("ns", np.int64)))
        keys, rough, exact = (np.frombuffer(b"".join(right[c].to_pylist()), kind) for c, kind in (("keys", _U), ("rough", np.float64), ("exact", np.int64)))
        order = np.argsort(keys)
        distinct, at = np.unique(h, return_inverse=True)
        ids = left["doc_ids"].combine_chunks().flatten()
        return pa.Table.from_batches([scored(ids, rid, h, np.repeat(np.arange(len(rid)), lengths), distinct, at, rough[order], exact[order])])

    if words_local:
        out = written(docs.mapInArrow(run, schema), "lm-scores")
    else:
        asked = written(docs.mapInArrow(_asked(shards), f"portion long, shard int, keys binary, rids binary, ns binary, doc_ids array<{id_type}>"), "lm-portions")
        asks, known = dealt(asked.where("shard is not null").select("portion", "shard", "keys"), table.where("kind = 0").select("shard", "m", "bits", "words", "counts"), group_bytes, shards)
        told = asks.groupBy("shard", "salt").cogroup(known.groupBy("shard", "salt")).applyInArrow(_told, "portion long, keys binary, rough binary, exact binary")
        whole = asked.where("shard is null").drop("shard")
        out = written(whole.groupBy("portion").cogroup(told.groupBy("portion")).applyInArrow(run_told, schema), "lm-scores")

    def rest(left: pa.Table, right: pa.Table) -> pa.Table:
        """Partial sums of a group of a shard's packs: exact logs of rare words, or probabilities of pairs."""
        empty = pa.table({"rid": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        if not len(left):
            return empty
        rid = np.frombuffer(b"".join(left["rids"].to_pylist()), np.int64)
        keys = np.frombuffer(b"".join(left["keys"].to_pylist()), _U)
        times = np.frombuffer(b"".join(left["ns"].to_pylist()), np.uint32)
        who, at = np.unique(rid, return_inverse=True)
        n_known, base, total = np.zeros(len(who), np.int64), np.zeros(len(who)), np.zeros(len(who))
        if left["befores"][0].is_valid:
            before, single = (np.frombuffer(b"".join(left[c].to_pylist()), np.float64) for c in ("befores", "singles"))
            own = Filter(1, [{"shard": 0, "m": r["m"], "bits": r["bits"]} for r in right.select(["m", "bits"]).to_pylist()])
            total = np.bincount(at, times * pair_log10(VALUES[own.levels(keys << _U(32))], before, single, b), len(who))
        elif len(right):
            w, c = np.frombuffer(right["words"][0].as_py(), _U), np.frombuffer(right["counts"][0].as_py(), np.int64)
            i = np.minimum(np.searchsorted(w, keys), len(w) - 1)
            found = w[i] == keys
            n_known = np.bincount(at, times * found, len(who)).astype(np.int64)
            base = np.bincount(at, np.where(found, times * np.log10(c[i] + 1), 0.0), len(who))
        return pa.table({"rid": pa.array(who), "n_known": pa.array(n_known), "base_score": pa.array(base), "score": pa.array(total)})

    packs = out.where("shard is not null").select("shard", "keys", "rids", "befores", "singles", "ns")
    tables = table.where("kind = 0").withColumn("bits", F.lit(b"")) if local else table
    tables = tables.select((F.col("shard") + F.col("kind") * shards).alias("shard"), "m", "bits", "words", "counts")
    packs, tables = dealt(packs, tables, group_bytes, shards)
    added = packs.groupBy("shard", "salt").cogroup(tables.groupBy("shard", "salt")).applyInArrow(rest, "rid long, n_known long, base_score double, score double")
    whole = out.where("shard is null").select("rid", "doc_id", "n_tokens", "n_known", "base_score", "score")
    both = whole.unionByName(added.select("rid", F.lit(None).cast(id_type).alias("doc_id"), F.lit(None).cast("long").alias("n_tokens"), "n_known", "base_score", "score"))
    return both.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
    ).drop("rid")
