"""Linking records by name, merging by key, and comparing snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text

#: Scores from which a match is accepted and from which it is worth a review.
ACCEPT, REVIEW = 0.8, 0.5
#: Fixed value: the ratio from which spellings count as alike.
SPELLED = 0.85


def scored(records: DataFrame, places: DataFrame, block: str, spelling: bool = False, bonus: float = 0.1) -> DataFrame:
    """Candidates (rid, pid, score): records (rid, norm, block) and places (pid, norm, block) that share a block.

    `spelling` also compares by edit structure, in a vectorised Python function over distinct pairs of names.
    """
    pairs = records.select("rid", F.col("norm").alias("_a"), block).join(places.select("pid", F.col("norm").alias("_b"), block), block)
    if not spelling:
        return pairs.select("rid", "pid", (text.name_score(F.col("_a"), F.col("_b")) + bonus).alias("score"))
    ratios = pairs.select("_a", "_b").distinct().withColumn("_ratio", text.sequence_ratio("_a", "_b"))
    return pairs.join(ratios, ["_a", "_b"]).select("rid", "pid", (text.name_score(F.col("_a"), F.col("_b"), F.col("_ratio")) + bonus).alias("score"))


def _bigrams(norm: Column) -> Column:
    """array<string>: the bigrams of a name, repeated ones told apart by a number."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(norm) - 1, F.lit(1))), lambda i: F.substr(norm, i, F.lit(2)))
    return F.transform(each, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(each, F.lit(1), i), lambda h: h == g)).cast("string")))


def _rare(names: DataFrame, counts: DataFrame, block: str) -> DataFrame:
    """(block, n, gram): of each distinct name the rarest bigrams that a name spelled alike must share one of, in the order of their frequency.

    Names whose ratio is SPELLED or more have SPELLED of their letters in common, in runs that are parted by the letters that differ. So they share 0.478 of the
    shorter one's letters less 1 as bigrams, and one of them is among the others of each.
    """
    grams = names.select(block, "n", F.explode(F.array_distinct(_bigrams(F.col("n")))).alias("gram")).join(counts, "gram")
    order = F.array_sort(F.collect_list(F.struct("often", "gram")))
    kept = F.greatest(F.length("n") - F.ceil(F.length("n") * 0.478 - 1.0), F.lit(1)).cast("int")
    return grams.groupBy(block, "n").agg(order.alias("g")).select(block, "n", F.explode(F.slice("g", F.lit(1), kept)).alias("s")).select(block, "n", F.col("s.gram").alias("gram"))


def alike_names(records: DataFrame, places: DataFrame, block: str, spelling: bool = False, bonus: float = 0.1) -> DataFrame:
    """(block, a, b, score): the names of records and places that are alike, each pair once: of the candidates of `scored` all with a score of REVIEW or more, found by keys instead of pairing whole blocks.

    Such pairs agree in their names, in their names without qualifiers, or in their sets of words, as half the words alone earn less; with `spelling` also those
    whose spelling is alike, which share one of their rarer bigrams. Distinct names are compared once.
    """
    bare, bag = text.strip_qualifiers(F.col("n")), F.array_join(F.array_sort(text.words(F.col("n"))), " ")
    ours, theirs = (df.where((F.col("norm") != "") & F.col(block).isNotNull()).select(block, F.col("norm").alias("n")).distinct() for df in (records, places))
    keyed = lambda df, name: df.select(block, F.col("n").alias(name), F.explode(F.array(F.struct(F.lit(1).alias("kind"), bare.alias("key")), F.struct(F.lit(2).alias("kind"), bag.alias("key")))).alias("k"))
    pairs = keyed(ours, "_a").join(keyed(theirs, "_b"), [block, "k"]).select(block, "_a", "_b")
    if spelling:
        both = ours.select("n").unionAll(theirs.select("n"))
        counts = both.select(F.explode(F.array_distinct(_bigrams(F.col("n")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("often"))
        spelled = _rare(ours, counts, block).withColumnRenamed("n", "_a").join(_rare(theirs, counts, block).withColumnRenamed("n", "_b"), [block, "gram"])
        near = 2 * F.least(F.length("_a"), F.length("_b")) >= SPELLED * (F.length("_a") + F.length("_b"))  # no more letters can be in common
        pairs = pairs.unionAll(spelled.where(near).select(block, "_a", "_b"))
    pairs = pairs.distinct()
    ratio = None
    if spelling:
        pairs = pairs.withColumn("_ratio", text.sequence_ratio("_a", "_b"))
        ratio = F.col("_ratio")
    pairs = pairs.withColumn("score", text.name_score(F.col("_a"), F.col("_b"), ratio) + bonus).where(F.col("score") >= REVIEW)
    return pairs.select(block, F.col("_a").alias("a"), F.col("_b").alias("b"), "score")


def alike(records: DataFrame, places: DataFrame, block: str, spelling: bool = False, bonus: float = 0.1) -> DataFrame:
    """(rid, pid, score): the links of `alike_names`, for each record and place that has such a name."""
    links = alike_names(records, places, block, spelling, bonus)
    found = records.select("rid", F.col("norm").alias("a"), block).join(links, [block, "a"])
    return found.join(places.select("pid", F.col("norm").alias("b"), block), [block, "b"]).select("rid", "pid", "score")


def alike_classes(records: DataFrame, places: DataFrame, block: str, spelling: bool = False, bonus: float = 0.1) -> DataFrame:
    """(part, id, other, score): what `alike` finds without a row for every pair. Records of one name and block are a class, places likewise, each with its smallest id.

    `record` and `place` rows tell the class of each row, `link` rows the classes of records (id) and places (other) that are alike.
    """
    ours, theirs = (df.where(F.col("norm").isNotNull() & F.col(block).isNotNull()) for df in (records, places))
    first = lambda df, key, name: df.groupBy(block, F.col("norm").alias(name)).agg(F.min(key).alias(f"_{name}"))
    a, b = first(ours, "rid", "a"), first(theirs, "pid", "b")
    none = F.lit(None).cast("double").alias("score")
    member = lambda df, key, classes, name, part: df.select(F.col(key).alias("id"), block, F.col("norm").alias(name)).join(classes, [block, name]).select(F.lit(part).alias("part"), "id", F.col(f"_{name}").alias("other"), none)
    links = alike_names(records, places, block, spelling, bonus).join(a, [block, "a"]).join(b, [block, "b"])
    links = links.select(F.lit("link").alias("part"), F.col("_a").alias("id"), F.col("_b").alias("other"), "score")
    return member(ours, "rid", a, "a", "record").unionByName(member(theirs, "pid", b, "b", "place")).unionByName(links)


def best(candidates: DataFrame) -> DataFrame:
    """(rid, pid, score, state): the best candidate of each record, the smallest pid of equals; `matched`, `review` or `unmatched`.

    Thresholds look at the score with its bonus; the score that is given out stops at 1.
    """
    top = candidates.groupBy("rid").agg(F.min_by(F.struct("pid", "score"), F.struct(-F.col("score"), F.col("pid"))).alias("b")).select("rid", "b.*")
    state = F.when(F.col("score") >= ACCEPT, "matched").when(F.col("score") >= REVIEW, "review").otherwise("unmatched")
    return top.withColumn("state", state).withColumn("score", F.least("score", F.lit(1.0)))


def all_best(candidates: DataFrame, least: float = ACCEPT) -> DataFrame:
    """Every candidate within 1e-9 of its record's best score, if that is at least `least`."""
    top = candidates.groupBy("rid").agg(F.max("score").alias("_top")).where(F.col("_top") >= least)
    return candidates.join(top, "rid").where(F.col("score") >= F.col("_top") - 1e-9).drop("_top")


def narrowed(candidates: DataFrame, *tests: Column) -> DataFrame:
    """Of each record's candidates those that pass the first test that any of them passes; all if none passes any."""
    w = Window.partitionBy("rid")
    first = F.coalesce(*[F.when(F.max(F.coalesce(t, F.lit(False))).over(w), F.lit(i)) for i, t in enumerate(tests)], F.lit(len(tests)))
    passes = F.lit(False)
    for i, t in enumerate(tests):
        passes = passes | ((F.col("_first") == i) & F.coalesce(t, F.lit(False)))
    return candidates.withColumn("_first", first).where(passes | (F.col("_first") == len(tests))).drop("_first")


def unmatched(records: DataFrame, matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Records without a match, with the number of their candidates and a reason."""
    counts = candidates.groupBy("rid").agg(F.count("*").alias("n_candidates"), F.max("score").alias("best_score"))
    out = records.join(matches.select("rid").distinct(), "rid", "left_anti").join(counts, "rid", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    return out.withColumn("reason", F.when(F.col("n_candidates") == 0, "no candidate").otherwise("no candidate is alike enough"))


def with_overrides(matches: DataFrame, forced: DataFrame, dropped: DataFrame) -> DataFrame:
    """Matches (rid, pid, ...) where records in `forced` have its pids alone, and the pairs in `dropped` are gone."""
    kept = matches.join(forced.select("rid").distinct(), "rid", "left_anti").join(dropped.select("rid", "pid"), ["rid", "pid"], "left_anti")
    return kept.unionByName(forced, allowMissingColumns=True)


def merged(rows: DataFrame, key: Column, id_col: str, *first: str) -> DataFrame:
    """Rows of equal keys as one: key, ids (distinct, sorted), and the smallest of each column in `first`."""
    return rows.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set(id_col)).alias("ids"), *[F.min(c).alias(c) for c in first])


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): new, removed or changed rows of two snapshots with the same columns. Rows are compared by hash, null-safe."""
    rest = sorted(c for c in new.columns if c != key)
    mark = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*[F.col(c).cast("string") for c in rest]), {"ignoreNullFields": "false"}), 256).alias(name))
    both = mark(old, "_old").join(mark(new, "_new"), key, "full_outer")
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(key, kind.alias("change")).where(F.col("change").isNotNull())


def search(names: DataFrame, query: str, limit: int = 8, floor: float = 0.42) -> DataFrame:
    """(id, name, tier, score): the best `limit` names for a query: those that begin with it, then those that hold it, then similar ones."""
    asked = F.lit(query)
    norm = text.normalize_name(F.col("name"))
    q = text.normalize_name(asked)
    rows = names.select("id", "name", norm.alias("_n"), q.alias("_q")).where((F.col("_n") != "") & (F.col("_q") != ""))
    score = text.trigram_score(text.trigrams(F.col("_q")), text.trigrams(F.col("_n")))
    tier = F.when(F.startswith("_n", "_q"), 0).when(F.instr(F.col("_n"), F.col("_q")) > 0, 1).when(score >= floor, 2)
    rows = rows.withColumn("tier", tier).where(F.col("tier").isNotNull()).withColumn("score", F.when(F.col("tier") == 2, score).otherwise(F.lit(1.0)))
    return rows.orderBy("tier", F.col("score").desc(), "name", "id").limit(limit).select("id", "name", "tier", F.round("score", 6).alias("score"))
