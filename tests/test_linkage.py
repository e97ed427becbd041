"""Candidates found by keys against all pairs of a block."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import linkage

WORDS = ["oak", "cedar", "heron", "stony", "north", "big", "saint", "clair", "ab", "long"]


def names(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choices(WORDS, k=r.randint(1, 3))
        t = " ".join(w)
        if r.random() < 0.6 and len(t) > 3:  # letters lost, doubled, swapped or put in between
            for _ in range(r.randint(1, 3)):
                p = r.randrange(len(t))
                t = r.choice([t[:p] + t[p + 1 :], t[:p] + t[p] + t[p:], t[:p] + "z" + t[p:], t[:p] + t[p + 1 : p + 2] + t[p : p + 1] + t[p + 2 :]])
        out.append((i, t, r.choice(["a", "a", "a", "b", None])))
    return [*out, (n, "", "a"), (n + 1, None, "a"), (n + 2, "oak", None)]


@pytest.mark.parametrize("spelling", [False, True])
def test_alike_finds_all_pairs_worth_a_review(spark, spelling):
    records = spark.createDataFrame(names(1, 150), "rid int, norm string, area string")
    places = spark.createDataFrame(names(2, 150), "pid int, norm string, area string")
    rows = lambda df: sorted((r.rid, r.pid, round(r.score, 9)) for r in df.collect())
    want = rows(linkage.scored(records, places, "area", spelling).where(F.col("score") >= linkage.REVIEW))
    assert rows(linkage.alike(records, places, "area", spelling)) == want and len(want) > 50
