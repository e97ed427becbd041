r"""Near-duplicates by MinHash: an inverted join on signature coordinates.

A document is the set of its word shingles; equal sets are one class. A class has a signature of `COORDINATES` minima, and is posted under
(coordinate, value) pairs. Two sets of similarity `threshold` agree in a binomial number of coordinates; pairs with fewer than
`matches` agreements are dropped, where `matches` is the largest bound that such a pair misses with a probability under `miss`.

Prefix and skip merging: a class's pairs are ordered by how many classes share them. Two classes with `matches` agreements share one of
their first COORDINATES - matches + 1, so only those are posted and longer lists are skipped; pairs that nobody shares use up their place
in the prefix and are not posted at all. Within a list, agreements of whole signatures are counted block against block, and a block
hands on only a spanning forest of the pairs it finds. The components of these links ("loose" groups) contain every true link;
within each, full shingle sets are compared block against block, exactly, and the components of the confirmed links are the result.

Scale: no list and no group is ever gathered whole or expanded into pairs of rows; blocks hold at most 2 * BLOCK rows a task step, a
list of n rows is copied n / BLOCK times. Texts are read twice: for signatures, and for the sets of the classes in loose groups.

Edge cases: texts with fewer words than a shingle are one shingle; null, empty and blank texts have none and link with nothing; equal texts
are one class of any size; rows that repeat a doc_id get a row each, whether
their texts agree or not; a null doc_id stands in no component's minimum; further columns, of whatever name, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, small, text_key, written
from tidemark.llm.graph import components

COORDINATES = 32
BLOCK = 2048
SET_BLOCK = 512
_RNG = np.random.default_rng(20_260_101)
MULTIPLY = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `words` consecutive words, A-Z lower-cased."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    if len(h) <= words:
        n = len(h)
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=n)], np.uint64) if n < words else np.unique(_mixed(h, words))
    return np.unique(_mixed(h, words))


def _mixed(h: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(len(h) - words + 1, np.uint64)
    for i in range(words):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):  # bounded memory for very long texts
        part = shingles[i : i + 4096, None]
        out = np.minimum(out, (((part * MULTIPLY + ADD) ^ (part >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).min(0))
    return (out >> np.uint64(33)).astype(np.int32)


def match_bound(threshold: float, miss: float = 1e-5) -> int:
    """The largest number of agreements that a pair of similarity `threshold` fails to reach with a probability under `miss`."""
    below, m = 0.0, 0
    while (below := below + math.comb(COORDINATES, m) * threshold**m * (1 - threshold) ** (COORDINATES - m)) < miss:
        m += 1
    return m


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows that agree in the first `keys` columns, from batches sorted by them."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        k = np.stack([table.column(i).to_numpy() for i in range(keys)], 1)
        if held and any(held[-1].column(i)[-1].as_py() != k[0, i] for i in range(keys)):
            yield pa.concat_tables(held)
            held = []
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if not len(cuts):
            held.append(table)
            continue
        yield pa.concat_tables([*held, table.slice(0, cuts[0])])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a + 1:
                yield table.slice(a, b - a)
        held = [table.slice(cuts[-1])]
    if held:
        yield pa.concat_tables(held)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    free, out = np.ones(len(linked), bool), []
    for i in range(len(linked)):
        if not free[i]:
            continue
        free[i], stack = False, [i]
        while stack:
            j = stack.pop()
            new = np.flatnonzero(linked[j] & free)
            free[new] = False
            out += [(j, int(x)) for x in new]
            stack += new.tolist()
    return out


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def block_pairs(rows: DataFrame, keys: list[str], size: str, node: str, block: int) -> DataFrame:
    """Each row once for every pair of blocks of its group that holds its own block: columns keys, bi, bj, own, then the rest; sorted runs."""
    n = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64(node, F.lit("block")), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other"))
    rest = [c for c in rows.columns if c not in (*keys, "bi", "bj", "own", "other")]
    return rows.select(*keys, "bi", "bj", "own", *rest).repartition(*keys, "bi", "bj").sortWithinPartitions(*keys, "bi", "bj")


def _apart(run: pa.Table, keys: int) -> np.ndarray | None:
    """Pairs of rows that this run has to compare: all, or those of different blocks."""
    if run.column(keys)[0].as_py() == run.column(keys + 1)[0].as_py():
        return None
    own = run.column(keys + 2).to_numpy()
    return own[:, None] != own[None, :]


def _loose(matches: int, percent: int):
    def run_all(batches):
        found: list[tuple[int, int]] = []
        for run in runs(batches, 3):
            nodes, n = run["node"].to_numpy(), run["n"].to_numpy()
            if len(nodes) < 2:
                continue
            column = run["sig"].combine_chunks()
            sig = column.flatten().to_numpy().reshape(len(nodes), COORDINATES)
            if len(nodes) == 2:
                if (sig[0] == sig[1]).sum() >= matches and 100 * n.min() >= percent * n.max():
                    found.append((int(nodes[0]), int(nodes[1])))
            else:
                agree = np.zeros((len(nodes), len(nodes)), np.uint8)
                for c in range(COORDINATES):
                    agree += sig[:, None, c] == sig[None, :, c]
                linked = (agree >= matches) & (100 * np.minimum(n[:, None], n[None]) >= percent * np.maximum(n[:, None], n[None]))
                if (apart := _apart(run, 1)) is not None:
                    linked &= apart
                found += [(int(nodes[a]), int(nodes[b])) for a, b in forest(linked)]
            if len(found) > 20_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return run_all


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of incidence matrices over slices of the shingles that two sets hold."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    name = np.cumsum(n > 1) - 1
    keep = n[at] > 1
    owner, at = owner[keep], name[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 8192
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, [lo, lo + width])
        part = np.zeros((len(sets), min(width, int(at[b - 1]) - lo + 1)), np.float32)
        part[owner[a:b], at[a:b] - lo] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _confirmed(percent: int):
    def run_all(batches):
        for run in runs(batches, 3):
            nodes = run["node"].to_numpy()
            if len(nodes) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in run["shingles"].to_pylist()]
            n = np.array([len(x) for x in sets])
            if len(nodes) == 2:
                both = len(np.intersect1d(*sets, assume_unique=True))
                linked = np.zeros((2, 2), bool)
                linked[:] = 100 * both >= percent * (n.sum() - both)
            else:
                both = _shared(sets)
                linked = 100 * both >= percent * (n[:, None] + n[None] - both)
                if (apart := _apart(run, 1)) is not None:
                    linked &= apart
            np.fill_diagonal(linked, False)
            yield _edges([(int(nodes[a]), int(nodes[b])) for a, b in forest(linked)])

    return run_all


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, root, component_id, kept) for each row of `docs` (doc_id, text).

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the smallest doc_id that
    links reach. `node` names the set (null for an empty one), `root` the least node of its component, text_key is a hash of the text.
    """
    docs = docs.select("doc_id", "text")

    def sketch(batches):
        for b in batches:
            out = []
            for t in b.column("text"):
                s = shingle_set(t.as_py(), words)
                out.append((len(s), node_of(s) if len(s) else None, signature(s) if len(s) else None))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True))], ["doc_id", "text_key", "n_shingles", "node", "sig"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    sketches = written(docs.withColumn("text_key", text_key(F.col("text"))).mapInArrow(sketch, f"doc_id {id_type}, text_key long, n_shingles long, node long, sig array<int>"), "sketches")
    classes = sketches.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.any_value("n_shingles").alias("n"), F.any_value("sig").alias("sig"))
    classes = written(classes, "classes")
    matches = match_bound(percent / 100)
    # Postings, and how many classes share each; those of one class alone only use up places of the prefix.
    keys = F.transform("sig", lambda v, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(v.cast("long")))
    posted = classes.select("node", F.explode(keys).alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = posted.join(lists, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("size", "key"))).alias("keys"))
    room = F.greatest(F.lit(0), F.lit(COORDINATES - matches + 1) - (F.lit(COORDINATES) - F.size("keys")))
    prefix = shared.select("node", F.slice("keys", F.lit(1), room).alias("keys")).where(F.size("keys") > 0).join(classes.select("node", "n", "sig"), "node")
    prefix = prefix.select("node", "n", "sig", F.explode("keys").alias("k")).select("k.key", "k.size", "node", "n", "sig")
    loose = components(block_pairs(prefix, ["key"], "size", "node", BLOCK).mapInArrow(_loose(matches, percent), "a long, b long").where("a is not null"))
    loose = written(loose, "loose")
    sizes = loose.groupBy("root").agg(F.count("*").alias("size"))
    loose, old = written(loose.join(sizes, "root").join(classes.select("node", "first_id"), "node"), "loose-sized"), loose
    discard(old)

    def sets(batches):
        for b in batches:
            found = [(node_of(s), s.tobytes()) for t in b.column(0).to_pylist() if len(s := shingle_set(t, words))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["node", "shingles"])

    texts = docs.join(small(loose.select(F.col("first_id").alias("f")).distinct()), F.col("doc_id").eqNullSafe(F.col("f")), "left_semi").select("text")
    full = texts.mapInArrow(sets, "node long, shingles binary").join(loose.select("node", "root", "size"), "node").dropDuplicates(["node"])
    groups = block_pairs(full, ["root"], "size", "node", SET_BLOCK)
    linked = components(groups.mapInArrow(_confirmed(percent), "a long, b long"))
    linked = linked.join(classes.select("node", "first_id"), "node")
    linked = written(linked, "linked")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # Every class has its first_id; classes with links have the least of their component.
    of_class = classes.select("node", "first_id").join(linked.select("node", "root").join(least, "root"), "node", "left")
    of_class = of_class.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"))
    return sketches.drop("sig").join(of_class, "node", "left").select(
        "doc_id", "text_key", "n_shingles", "node", "root", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )
