"""Exact top-k search by inner product on a bit-sliced index.

Components are quantised to integers, floor(scale * x). Rows are dealt into blocks of bounded size; a block holds, for each
component and bit, one bitmap over its rows (slices). For a query, each of its integers is written in powers of two, so the score
is a sum of shifted slices; full adders on whole bitmaps (three bitmaps of one weight to one of that weight and one of the next)
reduce it to the slices of the score. The top rows are then selected from the most significant slice downward; rows that tie at
the boundary are resolved exactly, by their score and id.

Scale: the index is built with one shuffle (rows to blocks); queries go in batches to every block, and each pair of a batch
and a block is a task's unit, so nothing is collected. Only k rows for each query and block reach the final ranking, whose window
keeps k rows a query before its shuffle too.

Edge cases: vectors that are null, empty, or hold nulls, NaN or infinities take no part; vectors of other lengths count as padded with 0;
a repeated id counts as often as it occurs, with each of its vectors, and as a query gathers the candidates of all of them; its own id is no
candidate. Equal rows (id and vector) are kept up to k times, as no ranking of k can hold more. Ties go to the smaller id; a query with fewer than k
candidates gets all. Quantised components saturate at +-10^15. Scores are exact beyond 64 bits and rank so; one that a long can't hold is given as the end of its range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Quantised components are at most this far from 0, so every sum has fewer than 127 bits.
MOST = 10**15
#: A score is high * 2^62 + low.
LOW_BITS = 62
BLOCK_ROWS = 16_384
QUERY_ROWS = 128


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int, k: int) -> DataFrame:
    """(id long, q array<long>, copy long): floor(scale * component) of the vectors that take part; equal rows are numbered, to `k` of them."""
    usable = (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    ints = F.transform(vector_col, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), ints.alias("q"))
    counted = rows.groupBy("id", "q").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("id", "q", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k)))).alias("copy"))


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.to_pylist()
    out = np.zeros((len(lists), max(map(len, lists), default=0)), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _sliced(table: pa.Table) -> pa.Table:
    """One block's slices: unsigned values x - low in bits, packed 64 rows a word."""
    ids = table["id"].to_numpy()
    order = np.argsort(ids)
    x = _matrix(table["q"])[order]
    low = int(x.min(initial=0))
    u = (x - low).astype(np.uint64)
    bits = max(1, int(u.max(initial=0)).bit_length())
    slices = np.stack([np.packbits(((u >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little") for b in range(bits)], 1)
    pad = -slices.shape[2] % 8
    slices = np.pad(slices, ((0, 0), (0, 0), (0, pad)))
    return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "low": pa.array([low], pa.int64()), "dims": pa.array([x.shape[1]], pa.int32()), "slices": pa.array([slices.tobytes()], pa.binary())})


def _bits(row: np.ndarray) -> np.ndarray:
    return np.unpackbits(row.view(np.uint8), bitorder="little")


def _added(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray | None]:
    """Sum of bitmaps by weight: each column is reduced to one bitmap by full and half adders, carries go to the next weight."""
    out: list[np.ndarray | None] = []
    w = 0
    while any(k >= w and v for k, v in columns.items()):
        parts = columns.pop(w, [])
        stack = np.concatenate([p if p.ndim == 2 else p[None] for p in parts]) if parts else None
        while stack is not None and len(stack) > 1:
            n = len(stack) // 3 if len(stack) > 2 else 0
            if n:
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                x = a ^ b
                carry, total = (a & b) | (x & c), x ^ c
                stack = np.concatenate([total, stack[3 * n :]])
            else:
                carry, stack = (stack[:1] & stack[1:]), (stack[:1] ^ stack[1:])
            columns.setdefault(w + 1, []).append(carry)
        out.append(None if stack is None else stack[0])
        w += 1
    return out


def _search(q: np.ndarray, own: int, slices: np.ndarray, low: int, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of a block for one query: (ids, high and low parts of their scores)."""
    n, bits = len(ids), slices.shape[1]
    live = np.packbits(np.concatenate([ids != own, np.zeros(slices.shape[2] * 64 - n, bool)]), bitorder="little").view(np.uint64)
    columns: dict[int, list[np.ndarray]] = {}
    base = 0
    inverted = ~slices if (q < 0).any() else slices
    # q * u for u of `bits` bits; where q < 0, |q| * (2^bits - 1 - u) is added instead and the constant is kept aside.
    for sign, source in ((1, slices), (-1, inverted)):
        mag = np.maximum(q * sign, 0)
        if sign < 0:
            base -= sum(mag.tolist()) * ((1 << bits) - 1)
        for j in range(int(mag.max(initial=0)).bit_length()):
            if (at := np.flatnonzero((mag >> j) & 1)).size:
                for b in range(bits):
                    columns.setdefault(j + b, []).append(source[at, b])
    base += sum(q.tolist()) * low
    total = _added(columns)
    above, tied, have = np.zeros_like(live), live, 0
    for s in reversed(total):
        if s is None:
            continue
        hit = tied & s
        count = int(np.bitwise_count(hit).sum())
        if have + count > k:
            tied = hit
        else:
            above, have, tied = above | hit, have + count, tied & ~s
            if have == k:
                tied = np.zeros_like(live)
                break
    # Rows in `above` beat the boundary; those in `tied` share its score, and ids ascend within a block.
    rows = np.concatenate([np.flatnonzero(_bits(above)), np.flatnonzero(_bits(tied))[: k - have]])
    mask = (1 << LOW_BITS) - 1
    high_part, low_part = np.full(len(rows), base >> LOW_BITS, np.int64), np.full(len(rows), base & mask, np.int64)
    bits_below = np.zeros(len(rows), np.int64)
    for w, s in enumerate(total):
        if s is not None:
            bit = ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            if w < LOW_BITS:
                bits_below += bit << w
            else:
                high_part += bit << (w - LOW_BITS)
    low_part += bits_below  # both are below 2^62
    return ids[rows], high_part + (low_part >> LOW_BITS), low_part & mask


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, id, score): each query's `k` rows of `vectors` with the highest integer inner product, its own id excluded."""
    rows, asks = (quantised(x, id_col, vector_col, scale, k) for x in (vectors, queries))
    n_blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    n_batches = max(1, -(-queries.count() // QUERY_ROWS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "q", "copy"), F.lit(n_blocks)).cast("int"))
    index = rows.groupBy("block").applyInArrow(_sliced, "block int, ids binary, low long, dims int, slices binary")
    asks = asks.groupBy(F.pmod(F.xxhash64("id", "q", "copy"), F.lit(n_batches)).cast("int").alias("batch")).agg(F.collect_list(F.struct("id", "q")).alias("asks"))
    asks = asks.select("asks", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                slices = np.frombuffer(r["slices"], np.uint64).reshape(r["dims"], -1, -(-len(ids) // 64))
                out: tuple[list, list, list, list] = ([], [], [], [])
                for ask in r["asks"]:
                    q = np.zeros(r["dims"], np.int64)
                    given = np.array(ask["q"][: r["dims"]], np.int64)
                    q[: len(given)] = given
                    found, high, low = _search(q, ask["id"], slices, r["low"], ids, k)
                    for o, v in zip(out, (np.full(len(found), ask["id"]), found, high, low), strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), pa.int64()) for o in out], ["query_id", "id", "high", "low"])

    found = asks.join(index, "block").mapInArrow(search, "query_id long, id long, high long, low long")
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "id")
    held = F.when(F.col("high") > 1, (1 << 63) - 1).when(F.col("high") < -2, -(1 << 63)).otherwise(F.shiftleft("high", LOW_BITS).bitwiseOR(F.col("low")))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", held.alias("score"))
