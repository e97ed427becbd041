"""Each corpus operator against a brute-force version or SQL on small frames with the awkward cases: nulls, empty texts, ties, repeats, clashing columns."""

import gzip
import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, mixing, neardup, ngram_lm, quality, substrings, topk, toxicity, warc

WORDS = [f"w{i}" for i in range(40)]


def corpus(seed=1, n=60, long=0):
    """Random texts with copies, near copies and shared passages; null, empty, blank and short ones among them."""
    r = random.Random(seed)
    texts = [" ".join(r.choices(WORDS, k=r.randint(1, 60))) for _ in range(n)]
    passage = " ".join(r.choices(WORDS, k=30))
    texts += [texts[0], texts[1] + " tail", texts[2].upper(), *(f"{' '.join(r.choices(WORDS, k=8))} {passage} {' '.join(r.choices(WORDS, k=8))}" for _ in range(5))]
    texts += [None, "", " \t\n", "one", "one", "a b c", "w1 " * 50, " ".join(r.choices(WORDS, k=long)) if long else "x"]
    return list(enumerate(texts))


def frame(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind)


def words(t):
    return (t or "").encode().split()


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(3)
    v = [(i, [float(x) for x in r.integers(-4, 5, 6) / 16]) for i in range(90)]
    v += [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (92, [float("nan")] * 6), (93, [float("inf")] * 6), (20, v[20][1])]
    df = frame(spark, v, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = {(x.query_id, x.rank): (x.id, x.score) for x in topk.top_k(df, df.where("vec_id % 20 = 0"), 5).collect()}
    q = [(i, np.floor(np.array(x) * 64).astype(int)) for i, x in [*v[:90], v[-1]]]
    for i in range(0, 81, 20):
        want = sorted(((j, int(a @ x)) for own, a in q if own == i for j, x in q if j != i), key=lambda p: (-p[1], p[0]))[:5]
        assert [got[i, k] for k in range(1, 6)] == want
    assert topk.top_k(df.where("vec_id < 0"), df, 5).count() == 0


def test_topk_keeps_every_row_of_a_repeated_id(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    r = np.random.default_rng(5)
    v = [(int(i), [float(x) for x in r.integers(-4, 5, 4) / 16]) for i in r.integers(0, 60, 80)]
    v += [(7, [1.0, 1.0, 1.0, 1.0])] * 30 + [(40, [0.5, 0.25, 0.5, 0.25])] * 9 + [(40, [-0.5, 0.25, 0.0, 0.25])]
    df = frame(spark, v, "vec_id long, embedding array<double>")
    got = {(x.query_id, x.rank): (x.id, x.score) for x in topk.top_k(df, df.where("vec_id % 20 = 0"), 12).collect()}
    q = [(i, np.floor(np.array(x) * 64).astype(int)) for i, x in v]
    want = {}
    for i in {i for i, _ in v if i % 20 == 0}:
        best = sorted(((j, int(a @ x)) for own, a in q if own == i for j, x in q if j != i), key=lambda p: (-p[1], p[0]))[:12]
        want |= {(i, k): b for k, b in enumerate(best, 1)}
    assert got == want


@pytest.mark.parametrize(("width", "percent"), [(4, 80), (5, 80), (2, 80)])
def test_near_duplicates_against_brute_force(spark, width, percent):
    rows = corpus(5, long=4000)
    rows += [(len(rows) + i, " ".join(WORDS[:30] * 3) + f" end{i % 3}") for i in range(12)]
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    low = {d: d for d in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    low[a] = low[b] = min(low[a], low[b])
        if all(low[low[d]] == low[d] for d in low):
            break
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(frame(spark, rows), width, percent).collect()}
    assert got == {d: (len(s), low[d], low[d] == d) for d, s in sets.items()}


def test_substrings_against_brute_force(spark):
    rows = corpus(7, long=900)
    rows.append((len(rows), " ".join((rows[-1][1] or "").split()[200:700])))
    first, gone = {}, {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            if first.setdefault(tuple(w[i : i + 13]), d) < d:
                gone.setdefault(d, set()).update(range(i, i + 13))
    df = frame(spark, rows).withColumn("n_words", F.lit("clash")).withColumn("start", F.lit(0))
    got = {x.doc_id: (x.n_removed, x.kept_text) for x in substrings.without_repeats(df, 13).collect()}
    want = {d: (len(gone.get(d, ())), None if t is None else b" ".join(x for i, x in enumerate(words(t)) if i not in gone.get(d, ())).decode()) for d, t in rows}
    assert got == want
    assert substrings.without_repeats(df.where("doc_id < 0")).count() == 0


def test_decontamination_against_brute_force(spark):
    docs = corpus(9)
    items = [(1, docs[3][1]), (2, " ".join(docs[4][1].split()[:12]) + " zz"), (3, "w1 w2"), (4, None), (5, ""), (6, docs[3][1].upper())]
    hits = {d: (set(), set()) for d, _ in docs}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, x in items:
            iw = (x or "").lower().split()
            n = min(10, len(iw))
            for p in range(len(w) - n + 1 if n else 0):
                if any(w[p : p + n] == iw[j : j + n] for j in range(len(iw) - n + 1)):
                    hits[d][0].update(range(p, p + n))
                    hits[d][1].add(i)
    found = decontam.decontaminate(frame(spark, docs).withColumn("items", F.lit(1)), frame(spark, items, "item_id long, text string")).collect()
    assert {x.doc_id: (set(x.hit_words), set(x.items)) for x in found} == hits
    clean = decontam.report(decontam.decontaminate(frame(spark, docs), frame(spark, [], "item_id long, text string"))).collect()
    assert len(clean) == len(docs) and not any(x.contaminated for x in clean)


def test_mixing_fills_targets(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), " ".join(["w"] * r.randint(0, 30))) for i in range(300)] + [(300, "b", None), (7, "a", "w w"), (7, "a", "w w")]
    mixed = mixing.mix(mixing.document_items(frame(spark, rows, "doc_id long, source string, text string"))).collect()
    assert len(mixed) == len(rows)
    for s in ("a", "b", None):
        own = [x for x in mixed if x.source == s]
        assert sum(x.size for x in own) == own[0].source_size and sum(x.taken for x in own) == int(own[0].target) and all(0 <= x.taken <= 3 * x.size for x in own)
    assert mixing.mix(mixing.document_items(frame(spark, [], "doc_id long, source string, text string"))).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = b"x<p>\r\n\r\nWARC/1.1\r\n" * 4000
    pages = [(1, "u1", big), (2, "u2", big), (3, "u\r\n3", b"small"), (4, None, b"small"), (5, "u5", None), (6, "u6", "é".encode() * 20_000)]
    warc.write_archives(frame(spark, pages, "key long, uri string, payload binary"), str(tmp_path / "w"), 1000)
    got = {int(x.key): x for x in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert {k: x.type for k, x in got.items()} == {1: "revisit", 2: "response", 3: "response", 4: "response", 5: "response", 6: "response"}
    assert got[1].refers_to == "2" and got[1].payload_bytes == len(big) and not any(x.error for x in got.values())
    assert all(bytes(got[k].payload) == (p or b"") for k, _, p in pages if k != 1)


def test_warc_reports_what_is_missing(spark, tmp_path):
    records = list(warc.response_records("<urn:a>", [("Tidemark-Key", "1")], b"y" * 9000, 4000))
    (tmp_path / "f.warc").write_bytes(warc.END.join([records[0], records[2]]) + warc.END)
    (r,) = warc.read_archives(spark, str(tmp_path / "f.warc")).collect()
    assert r.payload is None and r.error


@pytest.mark.parametrize("packed", [open, gzip.open])
def test_warc_records_that_end_at_a_buffers_end(spark, tmp_path, packed):
    record = lambda k, n: next(warc.response_records(f"<urn:{k}>", [("Tidemark-Key", k)], b"y" * n, 1 << 20))
    over = len(record("00", 65_000)) - 65_000
    for at in range(30):
        first = record(f"{at:02}", 65_536 - over - at)
        assert len(first) == 65_536 - at
        with packed(tmp_path / f"{at}.warc{'.gz' if packed is gzip.open else ''}", "wb") as f:
            f.write(b"".join(r + warc.END for r in (first, record(f"{at + 50}", 9))))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(x.key for x in got) == sorted(f"{x:02}" for at in range(30) for x in (at, at + 50)) and not any(x.error for x in got)


def test_warc_version_lines_at_every_border(spark, tmp_path):
    line = b"\r\nWARC/1.1"
    pages = [(i, "http://x/WARC/1.1", b"z" * i + line + tail) for i in range(60, 130) for tail in (b"", b"\r\n" + line)] + [(1, "WARC/1.1", line[2:])]
    pages = [(i, u, p) for i, (_, u, p) in enumerate(pages)]
    for payload in (p for _, _, p in pages):
        records = list(warc.response_records("<urn:a>", [], payload, 100))
        assert all((r[1:] + warc.END).count(warc.SEPARATOR) == 0 for r in records)
        assert b"".join(r.partition(warc.END)[2] for r in records).endswith(warc.chunked(payload)) and warc.dechunked(warc.chunked(payload, 70)) == payload
        assert warc.SEPARATOR not in warc.chunked(payload, 70)
    warc.write_archives(frame(spark, pages, "key long, uri string, payload binary"), str(tmp_path / "w"), segment_bytes=100)
    got = {int(x.key): x for x in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert {k: (x.uri, bytes(x.payload), x.error) for k, x in got.items()} == {k: (u, p, None) for k, u, p in pages}


def test_warc_blocks_of_others_that_hold_version_lines(spark, tmp_path):
    bodies = [b"a\r\nWARC/1.1\r\nb", b"\r\nWARC/1.1\r\n\r\nWARC/1.1\r\n", b"WARC/1.1\r\nWARC/1.1\r\n", b"plain"]
    records = [warc.record("response", f"<urn:{i}>", [("Tidemark-Key", i)], warc.HTTP + b"\r\n" + b) for i, b in enumerate(bodies)]
    cut = warc.record("response", "<urn:9>", [("Tidemark-Key", 9)], warc.HTTP + b"\r\n" + b"long")[:-2]
    (tmp_path / "f.warc").write_bytes(b"".join(r + warc.END for r in [cut, *records]))
    got = {int(x.key): x for x in warc.read_archives(spark, str(tmp_path / "f.warc")).collect()}
    assert got.keys() == {0, 1, 2, 3, 9} and got[9].payload is None and got[9].error
    assert [(bytes(got[i].payload), got[i].error) for i in range(4)] == [(b, None) for b in bodies]


@pytest.mark.parametrize("room", [256 << 20, 0])
def test_language_model_base_and_mass(spark, room):
    rows = corpus(11)
    train = lambda d: zlib.crc32(str(d).encode()) % 7 != 2
    tokens = {d: [*(t or "").lower().split(), None] for d, t in rows}
    counts = Counter(w for d, ws in tokens.items() if train(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = ngram_lm.score(frame(spark, rows), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, room).collect()
    assert len(got) == len(rows)
    for x in got:
        ws = tokens[x.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(ws), sum(w in counts for w in ws), n)
        assert x.base_score == pytest.approx(sum(log10((counts[w] + 1) / (n + v + 1)) for w in ws)) and x.score < 0
    empty = ngram_lm.score(frame(spark, []), F.lit(True))
    assert empty.count() == 0


def test_language_model_splits_what_one_shard_is_asked(spark, monkeypatch):
    rows = corpus(13) + [(1000 + i, "hot line " * 50 + f"rare{i} rare{i}") for i in range(40)]
    docs = frame(spark, rows).repartition(8)
    found = lambda **kw: {x.doc_id: x for x in ngram_lm.score(docs, F.lit(True), **kw).collect()}
    whole = found()
    monkeypatch.setattr(ngram_lm, "HEAD_WORDS", 12)
    sizes = {x.kind: x.bytes for x in ngram_lm.learn(docs, 12).groupBy("kind").agg(F.sum(F.octet_length("bits")).alias("bytes")).collect()}
    assert sizes[0] < sizes[1]
    for kw in ({"max_broadcast": 0, "group_bytes": 100}, {"max_broadcast": sizes[0], "group_bytes": 100}, {"group_bytes": 100}):
        got = found(**kw)
        assert got.keys() == whole.keys()
        for d, x in got.items():
            assert (x.n_tokens, x.n_known) == (whole[d].n_tokens, whole[d].n_known)
            assert (x.base_score, x.score) == pytest.approx((whole[d].base_score, whole[d].score))


def test_language_model_groups_are_bounded(spark):
    packs = frame(spark, [(0 if i else 1, bytes([i % 250, i // 250]) * 8, b"r" * 16, None, None, b"n" * 8) for i in range(2000)], "shard int, keys binary, rids binary, befores binary, singles binary, ns binary")
    left, right = ngram_lm.dealt(packs, frame(spark, [(0, 1), (1, 1), (2, 1)], "shard int, m long"), 4000)
    sizes = {(x.shard, x.salt): x["count"] for x in left.groupBy("shard", "salt").count().collect()}
    assert sum(sizes.values()) == 2000 and max(sizes.values()) * 40 < 2 * 4000 and sizes.keys() == {(x.shard, x.salt) for x in right.collect()} and right.count() == len(sizes)
    one, times = ngram_lm._summed(np.array([5, 7, 5, 5], np.uint64), np.array([0, 0, 0, 1]))
    assert (sorted(zip(one.tolist(), times.tolist())), len(ngram_lm._summed(np.array([], np.uint64), np.array([], int))[0])) == ([(0, 2), (1, 1), (3, 1)], 0)


def test_quality_learns_and_takes_anything():
    good, bad = ["the river runs down to the sea"] * 60, ["buy buy buy cheap cheap pills now"] * 60
    one = quality.train(good + bad, [1] * 60 + [0] * 60).scorer()
    assert one("the sea runs to the river") > 0.7 > 0.3 > one("cheap pills buy buy now") and 0 <= one(None) <= 1 and one("") == one(" ")
    assert quality.train(["a"], [1]).scorer()("x") > 0.5 and 0 <= quality.train([], []).scorer()("x") <= 1


def test_toxicity_sees_gapped_words():
    r = random.Random(4)
    plain = [" ".join(r.choices("river stone cloud window garden letter morning silver".split(), k=12)) for _ in range(150)]
    rude = [f"{t} you blorkhead. fine" for t in plain[:75]]
    one = toxicity.train(plain[75:] + rude, [0] * 75 + [1] * 75).scorer()
    clean = one("silver letter in the garden window")
    assert min(one("you bl0rkh3ad river stone"), one("you b.l.o.r.k.h.e.a.d window")) > clean and 0 <= one(None) <= 1
    assert toxicity.train(["a b c"], [0]).scorer()("abc") < 0.01


def test_language_prediction():
    en, de = ["the house and the garden with the tree"] * 40, ["das haus und der garten mit dem baum"] * 40
    one = langid.train(en + de, ["en"] * 40 + ["de"] * 40).predictor()
    assert one("the tree and the house")[0] == "en" and one("der baum und das haus")[0] == "de"
    assert one(None) == one("") == one("12 34 !!") == ("und", 0.0) and langid.train([], []).predictor()("x") == ("und", 0.0)


def test_scorers_keep_rows_and_columns(spark):
    docs = frame(spark, corpus()).withColumn("score", F.lit("clash"))
    for out in (quality.score(docs, quality.train([], [])), toxicity.score(docs, toxicity.train([], [])), langid.predict(docs, langid.train([], []))):
        assert out.count() == docs.count() and dict(out.dtypes)["score"] == "double"


def test_substrings_of_repeated_and_null_ids(spark):
    """Each text of a repeated doc_id is judged on its own windows; neither removes the other's words; helper names may be taken."""
    r = random.Random(21)
    a, b = (" ".join(r.choices(WORDS, k=20)) for _ in "ab")
    rows = [(1, a), (5, a + " zz"), (5, b), (5, b), (7, b), (7, b + " " + a), (None, a), (9, f"x {b} y"), (None, None)]
    first = {}
    for d, t in rows:
        for i in range(len(words(t)) - 12 if d is not None else 0):
            w = tuple(words(t)[i : i + 13])
            first[w] = min(d, first.get(w, d))
    want = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - 12 if d is not None else 0):
            if first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        want.append((d, t, len(gone), None if t is None else b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    df = frame(spark, rows)
    for c in ("span_first", "span_end", "tag", "row", "again", "name", "shared", "a.b"):
        df = df.withColumn(c, F.lit("clash"))
    out = substrings.without_repeats(df, 13)
    assert out.columns == [*df.columns, "n_words", "n_removed", "kept_text"]
    assert sorted(map(repr, want)) == sorted(repr((x.doc_id, x.text, x.n_removed, x.kept_text)) for x in out.collect())


def test_decontamination_of_repeated_ids_and_shuffled_join(spark, monkeypatch):
    docs = [(1, "a b c d e f g h i j k"), (1, "clean words only"), (1, "a b c d e f g h i j k"), (None, "É B C D E F G H I J"), (2, None)]
    bench = frame(spark, [(7, "x a b c d e f g h i j"), (8, "É b c d e f g h i j"), (9, "é b c d e f g h i j")], "item_id long, text string")
    for c in ("n", "h", "p", "ctx", "items"):
        bench = bench.withColumn(c, F.lit(1))
    want = sorted(map(repr, [(1, 11, 10, [7]), (1, 3, 0, []), (1, 11, 10, [7]), (None, 10, 10, [8]), (2, 0, 0, [])]))
    for most in (decontam.FINGERPRINT_ROWS, 0):
        monkeypatch.setattr(decontam, "FINGERPRINT_ROWS", most)
        got = decontam.decontaminate(frame(spark, docs), bench).collect()
        assert sorted(repr((x.doc_id, x.n_words, len(x.hit_words), list(x["items"]))) for x in got) == want


def test_near_duplicates_of_repeated_ids_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "SET_BLOCK", 3)
    base = WORDS[:30] * 2
    rows = [(i, " ".join([*base[:55], f"end{i}"])) for i in range(20, 3, -1)] + [(4, "other words of the same id here"), (None, " ".join(base[:56])), (3, None), (2, "")]
    got = [(x.doc_id, x.component_id, x.kept, x.root) for x in neardup.near_duplicates(frame(spark, rows).withColumn("root", F.lit(1)), 4, 80).collect()]
    group = {x[3] for x in got if x[0] not in (2, 3, 4)}
    assert len(group) == 1 and len(got) == len(rows)
    assert all(x[1] == 4 for x in got if x[3] in group) and sum(x[2] for x in got if x[3] in group) == 1
    assert sorted(x[:3] for x in got if x[3] is None) == [(2, 2, True), (3, 3, True)]
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_language_features_against_a_plain_loop():
    s = langid.Settings()
    texts = ["Don't stop", None, "", "  ", "a", "É b\tЖук 3x", "12 34", "x" * 50, "ΣΑΣ ΟΔΟΣ"]
    who, what = langid.features(texts, s)
    for i, t in enumerate(texts):
        grams = []
        for w in words(t):
            if letters := "".join(c for c in w.decode().lower() if c.isalpha()):
                w = f"_{letters}_"
                grams += [w[j : j + n] for n in s.grams for j in range(len(w) - n + 1) if w[j : j + n] != "_"]
        own = Counter(what[who == i].tolist())
        assert sorted(own.values()) == sorted(Counter(grams).values())
        assert own == Counter(langid.features([t], s)[1].tolist())


def test_quality_features_against_a_plain_loop():
    s = quality.Settings()
    texts = ["one one two", None, "", " \n", "a", "é b", "long" * 30, "the end"]
    who, what = quality.features(texts, s)
    for i, t in enumerate(texts):
        w = words(t)
        grams = [b"<" + x + b">" for x in w]
        many = [(0, x) for x in w] + [(n, g[j : j + n]) for g in grams for n in s.grams for j in range(len(g) - n + 1)]
        many += [(-1, b"") if a == b else (-2, a + b" " + b) for a, b in zip(w, w[1:])]
        own = Counter(what[who == i].tolist())
        assert sorted(own.values()) == sorted(Counter(many).values()) and own[s.buckets - 1] == sum(a == b for a, b in zip(w, w[1:]))
        assert own == Counter(quality.features([t], s)[1].tolist())


def test_samples_of_one_id_and_rare_values(spark):
    from tidemark.llm.common import labelled_sample, sample_of

    docs = frame(spark, [(7, f"text {i}") for i in range(3000)] + [(8, None)])
    langs = docs.withColumn("lang", F.when(F.col("text").endswith("99"), "rare").otherwise("common")).where("text is not null")
    got = sample_of(langs, "lang", ["text", "lang"], 200)
    assert got == sample_of(langs.repartition(7), "lang", ["text", "lang"], 200) and 60 < len(got) <= 200
    assert sum(x == "rare" for _, x in got) == 30
    assert len(sample_of(langs, "lang", ["text", "lang"], 200, most_bytes=100)) <= 12
    some = labelled_sample(docs, frame(spark, [(7, 1), (7, 1), (8, 0), (9, 0), (None, 1)], "doc_id long, toxic int"), "toxic", 100)
    assert 30 < len(some) <= 102 and {y for _, y in some} == {0, 1}
    assert sample_of(langs.where("false"), "lang", ["text", "lang"], 9) == []


def test_language_model_score_against_a_plain_model(spark):
    """Bigram probabilities from quantised counts in plain Python. The filter only ever reads a level too high, for about one key in seventy."""
    rows = corpus(17, n=150)
    tokens = {d: [*words((t or "").lower()), b" end"] for d, t in rows}
    single = Counter(w for ws in tokens.values() for w in ws)
    pairs = Counter(p for ws in tokens.values() for p in zip([b" end", *ws], ws))
    n, v = sum(single.values()), len(single)
    b = np.log(len(pairs)) / np.log(n)
    rough = lambda c: ngram_lm.VALUES[1 + int(np.log(c) / np.log(1.5) + 1e-9)] if c else 0.0
    got = {x.doc_id: x for x in ngram_lm.score(frame(spark, rows), F.lit(True)).collect()}
    off = []
    for d, ws in tokens.items():
        want = 0.0
        for before, w in zip([b" end", *ws], ws):
            p, c = (rough(single[w]) + 1) / (n + v + 1), rough(single[before])
            want += log10((min(rough(pairs[before, w]), c) + c**b * p) / (c + c**b))
        off.append(abs(got[d].score - want) / len(ws))
    assert np.mean(off) < 0.03 and max(off) < 0.4


def test_language_model_portions_run_over_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(range(4 * i, 4 * i + 4)), pa.array(["a b", None, "c", "d e f"])], ["doc_id", "text"]) for i in range(5)]
    whole = list(ngram_lm.portions(iter(batches), 1000))
    cut = list(ngram_lm.portions(iter(batches), 15))
    assert len(whole) == 1 and len(cut) > 2 and np.concatenate([h for _, h, _ in cut]).tolist() == whole[0][1].tolist()
    assert [x for r, _, _ in cut for x in r.column("doc_id").to_pylist()] == list(range(20))
    assert all(row.max() == len(r) - 1 for r, _, row in cut) and list(ngram_lm.portions(iter([]), 5)) == []
