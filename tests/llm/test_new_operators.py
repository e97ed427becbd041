"""URL filters, importance resampling and collocations against brute-force versions, with nulls, repeats, ties, long texts and clashing columns; limits of earlier operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations, common, decontam, langid, resampling, topk, urlfilter
from tidemark.llm.queries import URL_RULES

CLASHES = ("rule", "node", "root", "salt", "rank", "weight", "bucket", "n", "words", "id", "block", "f", "copy", "place", "h")


def clashing(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


PAGES = [
    (1, "https://a.example.net/en/1", '<link rel="canonical" href="https://x.example.com/de/9">'),  # its canonical name is blocked
    (2, "https://b.example.net/en/2", "<link rel=canonical href='/../en/./up/../1'><p>"),
    (3, "https://A.example.NET/en/1#top", None),
    (4, "https://c.example.org/en/2", '<LINK href="https://a.example.net/en/1" REL="nofollow Canonical">'),  # allowed by a rule, whatever its alias
    (5, "http://d.example.net/", '<meta http-equiv="refresh" content="0; URL=\'https://b.example.net/en/2?a=1&amp;b=2\'">'),
    (6, "https://b.example.net/en/2?a=1&b=2", '<link rel="canonical" href="?">'),
    (7, "https://e.example.net", '<meta http-equiv="refresh" content="30;url=https://x.example.com/de/9">'),  # no immediate refresh
    (8, "https://f.example.net/x", '<!-- <link rel="canonical" href="https://x.example.com/de/9"> --><script>"<link rel=canonical href=https://x.example.com/de/9>"</script>'),
    (9, "https://g.example.net/x?p=https://h/i", '<link rel="canonical" href="mailto:a@b"><link rel="alternate" href="https://x.example.com/de/9">'),
    (10, None, '<link rel="canonical" href="https://x.example.com/de/9">'),
    (11, "no address", None),
    (12, "https://example.org/es/1", None),
    (13, "https://notexample.org/es/1", None),
    (14, "https://example.org/en/10", None),
    (15, "https://k.example.net/a/b", '<link rel="canonical" href="c">'),
    (16, "https://k.example.net/a/c", None),
    (None, "https://e.example.net", None),
    (1, "https://a.example.net/en/1", '<link rel="canonical" href="https://x.example.com/de/9">'),
    (17, "https://ÀB.example.com/fr/1", ""),
]


def judged(spark, pages, redirects=None):
    df = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))
    rows = urlfilter.judge(df, URL_RULES, redirects).collect()
    return sorted((r.page_id if r.page_id is not None else -1, r.host, r.path, r.rule, r.verdict, r.blocked_by) for r in rows)


def test_url_filters(spark):
    blocked = "https://x.example.com/de/9"
    got = {r[0]: r[1:] for r in judged(spark, PAGES)}
    assert len(judged(spark, PAGES)) == len(PAGES)
    assert got[1] == ("a.example.net", "/en/1", None, "block", blocked) and got[3] == got[1]
    assert got[2][2:] == (None, "allow", None)  # b's /en/1 is no alias of a's
    assert got[4] == ("c.example.org", "/en/2", "org/", "allow", None)
    assert got[5][3] == got[6][3] == "allow" and got[7][3] == got[8][3] == got[9][3] == "allow"
    assert got[10] == got[11] == ("", "", None, "allow", None) and got[-1] == ("e.example.net", "", None, "allow", None)
    assert got[12][2:4] == ("example.org/es/", "block") and got[13][2:4] == ("org/", "allow") and got[14][2:4] == ("example.org/en/1", "block")
    assert got[17][:4] == ("Àb.example.com", "/fr/1", "com/fr/", "allow")


def test_redirects_join_components_and_long_chains(spark, monkeypatch):
    chain = [(f"https://n{i}.example.net/p", f"https://n{i + 1}.example.net/p") for i in range(40)] + [("https://n40.example.net/p#x", "https://s.example.com/de/"), (None, "x"), ("x", "y")]
    redirects = spark.createDataFrame(chain, "from_url string, to_url string")
    pages = [(i, f"https://n{i}.example.net/p", None) for i in range(41)] + [(50, "https://other.example.net/p", None)] + [(60, "https://n3.example.net/p", None)] * 30
    want = [(i, "block", "https://s.example.com/de/") for i in range(41)] + [(50, "allow", None)] + [(60, "block", "https://s.example.com/de/")] * 30
    assert [(r[0], r[4], r[5]) for r in judged(spark, pages, redirects)] == want
    monkeypatch.setattr(urlfilter, "ALIAS_BYTES", -1)  # the shuffled, salted way
    assert [(r[0], r[4], r[5]) for r in judged(spark, pages, redirects)] == want
    assert judged(spark, []) == []


def components_by_hand(edges):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        root[find(a)] = find(b)
    return {x: find(x) for x in root}


def test_url_components_against_union_find(spark):
    r = random.Random(4)
    names = [f"https://h{i}.example.{r.choice(['net', 'com'])}/{r.choice(['de', 'en', 'fr'])}/p" for i in range(60)]
    pages = [(i, u, "".join(f'<link rel="canonical" href="{r.choice(names)}">' for _ in range(r.choice([0, 0, 1, 2])))) for i, u in enumerate(names)]
    edges = [(u, t) for _, u, h in pages for t in re.findall('href="([^"]*)"', h)]
    root = components_by_hand(edges)
    bad = {root.get(u) for u in names if ".com/de/" in u} - {None}
    want = {i: "block" if ".com/de/" in u or (".com/fr/" not in u and root.get(u) in bad) else "allow" for i, u, _ in pages}
    assert {x[0]: x[4] for x in judged(spark, pages)} == want


TEXT_WORDS = ["Alpha", "beta", "gamma7", "Éclair", "straße", "x", "ÄB", "deux"]


def texts(seed=2, n=70):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choices(TEXT_WORDS, k=r.randint(0, 60)))) for i in range(n)]
    return [*rows, (3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (None, None), (200, None), (201, " \t"), (202, "Beta, BETA-beta " * 4000)]


def plain_words(t):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]


@pytest.mark.parametrize("high", [1, 3])
def test_resampling(spark, high):
    docs, target = texts(), [("alpha beta x straße",), ("GAMMA7 alpha alpha",), (None,)]
    feats = lambda t: [" ".join(w[i : i + n]) for w in [plain_words(t)] for n in range(1, high + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 500
    s, t = Counter(bucket(f) for _, x in docs for f in feats(x)), Counter(bucket(f) for (x,) in target for f in feats(x))
    s_all, t_all = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 500) / ((s[b] + 1.0) * (t_all + 500))))
    want = []
    for i, x in docs:
        f = feats(x)
        weight = math.floor(Fraction(sum(gain(bucket(y)) for y in f), len(f))) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), None, len(plain_words(x))])
    able = sorted((w for w in want if w[5] >= 20), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    for rank, w in enumerate(able[: len(able) * 30 // 100], 1):
        w[4] = rank
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    got = resampling.resample(df, clashing(spark.createDataFrame(target, "text string")), 1, high, 500, "7", 20, 30).collect()
    assert sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in got) == sorted(repr(tuple(w[:5])) for w in want)


def test_resampling_of_many_copies_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(resampling, "COPIES", 7)
    docs = spark.createDataFrame([(5, "a b c " * 10)] * 300 + [(6, "a b " * 15)], "doc_id long, text string")
    got = resampling.resample(docs, docs.where("doc_id = 6").select("text"), percent=50).collect()
    assert len(got) == 301 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 151))
    none = docs.where("doc_id < 0")
    assert resampling.resample(none, none.select("text")).count() == 0


def plain_collocations(docs, longest, least, percent, first):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [((1000 * a * n[lang]) // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score)
    inner = lambda p, q: len(p) < len(q) and any(q[i : i + len(p)] == p for i in range(len(q)))
    kept = [(lang, p, v) for (lang, p), v in found.items() if not any(o == lang and inner(p, q) and 100 * w[0] >= percent * v[0] for (o, q), w in found.items())]
    out = []
    for lang in sorted(n):
        own = sorted(((-v[4], -v[0], " ".join(p).encode(), v) for o, p, v in kept if o == lang))[:first]
        out += [(lang, rank, p.decode(), *v[:4], v[4]) for rank, (_, _, p, v) in enumerate(own, 1)]
    return out


@pytest.mark.parametrize(("percent", "first", "block", "sent"), [(100, 2000, 1 << 20, 1 << 20), (80, 6, 40, 1 << 20), (100, 2000, 40, -1)])
def test_collocations(spark, monkeypatch, percent, first, block, sent):
    monkeypatch.setattr(collocations, "BROADCAST_BYTES", sent)  # -1: the shuffled way
    r = random.Random(9)
    phrases = ["New York City", "à la carte menu", "of the", "a a a a", "Zürich\tsee", "one two three four five six"]
    make = lambda: r.choice([" ", ", ", ". ", "  ", "\n", " \t"]).join(r.choice(phrases) if r.random() < 0.5 else r.choice(TEXT_WORDS) for _ in range(r.randint(0, 40)))
    docs = [(r.choice(["en", "fr", "und", None]), make()) for _ in range(60)]
    docs += [("en", None), ("en", ""), (None, ".,;"), ("fr", docs[0][1]), ("fr", docs[0][1]), ("en", "new york " * 3000), ("en", "nul \x00 end." * 5)]
    want = plain_collocations(docs, 5, 4, percent, first)
    df = clashing(spark.createDataFrame(docs, "lang string, text string"))
    if block < 1000:  # several blocks a partition, several portions a text; the workers take the module's values from their own import
        real = collocations._post
        def small_blocks(batches):
            collocations.BLOCK, collocations.PORTION = block, 30
            return real(batches)
        monkeypatch.setattr(collocations, "_post", small_blocks)
    got = collocations.collocations(df, 5, 4, percent, first).collect()
    assert sorted(tuple(x) for x in got) == sorted(want) and len(want) > 10


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([("en", None)], "lang string, text string")
    assert collocations.collocations(df).count() == 0 and collocations.collocations(df.where("lang = 'x'")).count() == 0


def test_topk_of_huge_components(spark):
    v = [(i, [x, 2.0 * (i % 3)]) for i, x in enumerate([1e12, -1e12, 1e300, -1e300, 3.0, 0.5, 1e11])]
    q = {i: [max(-(10**15), min(10**15, math.floor(64 * x))) for x in xs] for i, xs in v}
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df, 6).collect()
    for i in q:
        exact = sorted(((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i))
        assert [(r.id, r.score) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == [(j, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, j in exact]


def test_an_item_without_id_counts(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five six")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three"), (7, "one two three"), (None, "four five six")], "item_id string, text string")
    got = {r.doc_id: (r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(decontam.decontaminate(docs, items)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (2, sha("7"), True), 2: (1, sha(""), True)}


def test_samples_hold_every_value(spark):
    rows = [(f"text {i} of a frequent one", "big") for i in range(3000)] + [("z" * 3000, f"l{i}") for i in range(700)] + [("no language", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = common.sample_of(df, "lang", ["text", "lang"], 300, most_bytes=100_000)
    assert Counter(lang for _, lang in got).keys() == {lang for _, lang in rows if lang} and got == common.sample_of(df.repartition(7), "lang", ["text", "lang"], 300, most_bytes=100_000)
    assert len(common.sample_of(df.where("lang = 'big'"), "lang", ["text", "lang"], 50)) == 50


def test_many_languages_are_learned(spark):
    # Each of 600 languages has letters of its own.
    letter = lambda i: chr(0x4E00 + i)
    rows = [(i * 2 + j, (letter(i) * 3 + " ") * 6, f"l{i:03}") for i in range(600) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df).langs == sorted({x[2] for x in rows})


def test_blocks_are_unpacked_one_at_a_time(spark):
    rows = spark.range(0, 9, 1, 2).selectExpr("id AS block", "array(id, id + 1) AS ids")
    files = {f.removeprefix("file://") for f in common.written(rows, "blocks", collocations.GROUP_BLOCKS).inputFiles()}
    assert sum(pq.ParquetFile(f).num_row_groups for f in files) == 9  # a reader holds one block, not all of a file
    batch = pa.RecordBatch.from_pydict({"block": [1, 2], "word_at": [b"a", b"b"], "ids": [[1, 2], None], "lang": [["en"], []]})
    states = collocations._states(iter([batch]))
    one, two = next(states), next(states)
    assert isinstance(one["ids"], np.ndarray) and one["ids"].tolist() == [1, 2] and one["lang"] == ["en"] and two["ids"] is None and two["block"] == 2
