"""The corpus queries on the smallest tables: against SQL where there is some, else held-out accuracy and whole results."""

import glob
import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(repr([plain(x) for x in r]) for r in df.collect()) == sorted(repr([plain(r[cols.index(c)]) for c in df.columns]) for r in cur.fetchall())


@pytest.mark.parametrize(("name", "label"), [("op2_toxicity_svm", "toxic"), ("op7_quality_subwords", "quality")])
def test_held_out_accuracy(spark, name, label):
    got = queries.queries()[name](spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("predicted", label).collect()
    assert sum(a == b for a, b in rows) >= 0.7 * len(rows) and got.count() == 200


def test_languages(spark):
    got = queries.op9_language_ftrl(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(x.lang == x.lang_pred for x in got) >= 0.8 * len(got)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= kept.count() and out.where("taken <= 0").isEmpty()


def rows_of(df, columns):
    return sorted(repr(tuple(x[c] for c in columns)) for x in df.collect())


def awkward(spark, n=40):
    """Documents with null and repeated ids, copies, passages, a benchmark item, null texts, and columns that the stages' helpers are called too."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(5, 80))) for _ in range(n)]
    passage = " ".join(r.choices(vocabulary, k=20))
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, f"{texts[i]} {passage} q{i}") for i in range(3)]
    rows += [(None, texts[0]), (None, texts[0]), (None, None), (2, texts[5]), (3, texts[3]), (3, texts[3]), (200, ""), (201, None), (4, texts[4] + " more")]
    df = spark.createDataFrame([(d, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("size", "id", "tie", "gone", "gone_id", "score", "n_words", "row", "count", "k"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def shingles(t, n=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_duplicate_stage_against_brute_force(spark):
    docs = awkward(spark)
    rows = docs.collect()
    sets, low = [shingles(x.text) for x in rows], list(range(len(rows)))
    order = sorted(range(len(rows)), key=lambda i: (rows[i].doc_id is None, rows[i].doc_id or 0))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
    best = {}
    for i in order:
        best.setdefault(low[i] if sets[i] else ("none", i), i)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(map(repr, got.select("doc_id").collect())) == sorted(repr(Row(doc_id=rows[i].doc_id)) for i in best.values())
    assert all(any(x.text == rows[i].text or shingles(x.text) & sets[i] for i in best.values()) for x in got.collect() if x.text)


def test_substring_stage_against_brute_force(spark):
    docs = awkward(spark)
    first = {}
    for x in docs.collect():
        w = (x.text or "").split()
        for i in range(len(w) - 12 if x.doc_id is not None else 0):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, x.doc_id), x.doc_id)
    want = []
    for x in docs.collect():
        w = (x.text or "").split()
        gone = {j for i in range(len(w) - 12 if x.doc_id is not None else 0) if first[tuple(w[i : i + 13])] < x.doc_id for j in range(i, i + 13)}
        if not gone or len(gone) < len(w):
            text = " ".join(y for i, y in enumerate(w) if i not in gone) if gone else x.text
            want.append(repr((x.doc_id, text, x.lang, x.source, len(text) if gone else x.n_chars, x.n_words)))
    got = corpus_pipeline.cut_repeats(spark, docs, SF)
    assert got.columns == docs.columns and rows_of(got, ["doc_id", "text", "lang", "source", "n_chars", "n_words"]) == sorted(want)


def test_leak_stage_against_brute_force(spark, tmp_path):
    docs = awkward(spark)
    rows = docs.collect()
    items = [rows[1].text, rows[0].text.upper(), "w1 w2", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    grams = {tuple(w[i : i + min(10, len(w))]) for t in items if (w := (t or "").lower().split()) for i in range(len(w) - min(10, len(w)) + 1)}
    leaks = lambda t: any(tuple(w[i : i + n]) in grams for w in [(t or "").lower().split()] for n in {len(g) for g in grams} for i in range(len(w) - n + 1))
    got = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and rows_of(got, docs.columns) == sorted(repr(tuple(x)) for x in rows if not leaks(x.text))


def test_mix_stage_takes_each_row_once(spark):
    docs = awkward(spark)
    out = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    rows = docs.collect()
    assert Counter((x.doc_id, x.text, x.source) for x in out) <= Counter((x.doc_id, x.text, x.source) for x in rows)
    sizes = Counter()
    for x in rows:
        sizes[x.source] += len((x.text or "").split())
    for s in sizes:
        own = [x for x in out if x.source == s]
        assert sum(x.taken for x in own) == int(own[0].target) and own[0].source_size == sizes[s] and all(0 < x.taken <= 3 * x.size for x in own)


def test_quality_stage_keeps_clean_rows(spark):
    sf = SF.replace("0.001", "0.01")  # SF has 8 rows of low quality to learn from
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("clash")), spark.read.parquet(f"{sf}/labels.parquet")
    got = corpus_pipeline.keep_quality(spark, docs, sf)
    assert got.columns == docs.columns and got.where("score = 'clash'").count() == got.count()
    kept = {x.doc_id for x in got.select("doc_id").collect()}
    marks = {x.doc_id: x.quality for x in labels.collect() if x.doc_id in {y.doc_id for y in docs.collect()}}
    assert all(d in kept for d, q in marks.items() if q == 1) and sum(d not in kept for d, q in marks.items() if q == 0) >= 0.9 * sum(q == 0 for q in marks.values())
