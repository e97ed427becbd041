"""The corpus queries, one for each operator and one for the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import collocations, decontam, langid, mixing, neardup, ngram_lm, quality, resampling, substrings, topk, toxicity, urlfilter, warc
from tidemark.llm.common import held_out, new_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def _classified(scored: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_toxicity_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)), "toxic")
    return _classified(toxicity.score(docs, model), 4, 2)


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_read(spark, sf_dir, "documents"), words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _read(spark, sf_dir, "documents").select("doc_id", "text"), held_out(F.col("doc_id"), 7, 2)
    scored = ngram_lm.score(docs, ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.document_items(_read(spark, sf_dir, "documents")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH i AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             coalesce(CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * length(regexp_replace(text, '[^\p{L}]+', '', 'g')) / greatest(length(text), 1), 1.0) AS weight,
             (CAST(CAST('0x' || substr(sha1('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
           FROM documents),
k AS (SELECT *, -ln(u) / greatest(weight, 1e-9) AS es_key FROM i),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM k GROUP BY source),
c AS (SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0) AS rem, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_rem
      FROM p WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CAST(rem AS DOUBLE) / CAST(w_rem AS DOUBLE) AS rate FROM c),
b AS (SELECT rate FROM r WHERE rate * w <= 3 * source_size ORDER BY source_size / w LIMIT 1),
t AS (SELECT source, source_size, round(least(3.0 * CAST(source_size AS DOUBLE), coalesce((SELECT rate FROM b), 0.0) * w), 6) AS target FROM p),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
m AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size AS rest,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY es_key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM m
"""


def op6_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload"))
    path = new_path(spark, "warc")
    warc.write_archives(pages, path, min_revisit=1000)
    records = warc.read_archives(spark, path, payloads=False)
    return records.select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to")
    )


OP6_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


def op7_quality_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)), "quality")
    return _classified(quality.score(docs, model), 5, 0)


def op9_language_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.where(~out).select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op10_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.without_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), window=13))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
c AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM g JOIN f USING (g) WHERE doc_id > first GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id
"""


def op8_winnow_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.decontaminate(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"), window=10)
    return decontam.report(hits)


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


#: Fixed values of the query: verdict, host, path.
URL_RULES = (
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
)


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages"), URL_RULES)


OP11_SQL = r"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(verdict, h, p)),
tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g'), '(?i)<(?:link|meta)\s[^<>]*>')) AS tag FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
attrs AS (SELECT *, list_transform(['rel', 'href', 'http-equiv', 'content'], lambda a: replace(trim(list_aggregate(list_transform([1, 2, 3], lambda g:
            CASE g WHEN 1 THEN regexp_extract(tag, '(?i)\s' || a || '\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1) WHEN 2 THEN regexp_extract(tag, '(?i)\s' || a || '\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2)
              ELSE regexp_extract(tag, '(?i)\s' || a || '\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3) END), 'string_agg', '')), '&amp;', '&')) AS v FROM tags),
links AS (SELECT url, v[2] AS link FROM attrs WHERE tag ILIKE '<link%' AND regexp_matches(lower(v[1]), '(^|\s)canonical(\s|$)')
          UNION SELECT url, trim(regexp_extract(v[4], '(?i)^\s*0*(?:\.0*)?\s*[;,]\s*url\s*=\s*[''"]?\s*([^''"]+)', 1)) FROM attrs WHERE tag ILIKE '<meta%' AND lower(v[3]) = 'refresh'),
based AS (SELECT url, regexp_replace(link, '(?s)#.*$', '') AS link, regexp_extract(url, '^(.*?)://', 1) AS scheme, regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM links),
whole AS (SELECT url, CASE WHEN link = '' THEN NULL WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN regexp_matches(link, '(?i)^https?://[^/?#]') THEN link END
            WHEN starts_with(link, '//') THEN scheme || ':' || link WHEN starts_with(link, '/') THEN scheme || '://' || host || link WHEN starts_with(link, '?') THEN scheme || '://' || host || path || link
            ELSE scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)', 1) END || link END AS target FROM based),
named AS (SELECT DISTINCT u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
            translate(regexp_extract(u, '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS scheme, regexp_extract(u, '^[^?#]*(\?[^#]*)', 1) AS query
          FROM (SELECT url AS u FROM pages UNION SELECT target FROM whole) WHERE u LIKE '%://%'),
dots AS (SELECT u, host, path, scheme || '://' || host || CASE WHEN path = '' THEN '/' WHEN regexp_matches(path, '/\.\.?(/|$)')
            THEN '/' || array_to_string(list_reduce(list_transform(string_split(path, '/')[2:], lambda s: [s]), lambda acc, s: CASE s[1] WHEN '.' THEN acc WHEN '..' THEN acc[:-2] ELSE acc || s END, CAST([] AS VARCHAR[])), '/')
              || CASE WHEN regexp_matches(path, '/\.\.?$') AND len(list_reduce(list_transform(string_split(path, '/')[2:], lambda s: [s]), lambda acc, s: CASE s[1] WHEN '.' THEN acc WHEN '..' THEN acc[:-2] ELSE acc || s END, CAST([] AS VARCHAR[]))) > 0 THEN '/' ELSE '' END
            ELSE path END || query AS address FROM named),
ruled AS (SELECT d.u, d.address, d.host, d.path, (arg_max(r.h || r.p, length(r.h || r.p))) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
          FROM dots d LEFT JOIN rules r ON (d.host = r.h OR ends_with(d.host, '.' || r.h)) AND starts_with(d.path, r.p) GROUP BY ALL),
edges AS (SELECT DISTINCT a.address AS a, b.address AS b FROM whole w JOIN dots a ON a.u = w.url JOIN dots b ON b.u = w.target WHERE a.address <> b.address),
met AS (SELECT address AS source, address AS node FROM ruled WHERE verdict = 'block' AND address IN (SELECT a FROM edges UNION SELECT b FROM edges)
        UNION SELECT m.source, e.b FROM met m JOIN (SELECT a, b FROM edges UNION SELECT b, a FROM edges) e ON m.node = e.a),
least_of AS (SELECT node, min(source) AS blocked_by FROM met GROUP BY node)
SELECT p.page_id, coalesce(r.host, '') AS host, coalesce(r.path, '') AS path, r.rule, coalesce(r.verdict, CASE WHEN f.node IS NULL THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN r.rule IS NULL THEN f.blocked_by END AS blocked_by
FROM pages p LEFT JOIN ruled r ON r.u = p.url LEFT JOIN least_of f ON f.node = r.address
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), low=1, high=1, buckets=10_000, seed="2024", min_words=20, percent=10)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
dw AS (SELECT row, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
w AS (SELECT word, xor(list_reduce(list_transform(range(1, CAST(length(hex(encode(word))) AS BIGINT), 2), lambda j: CAST('0x' || substr(hex(encode(word)), j, 2) AS BIGINT)),
               lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
s AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS n FROM dw JOIN w USING (word) GROUP BY bucket),
t AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS n FROM bw JOIN w USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT) AS gain
      FROM (SELECT DISTINCT bucket FROM w) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
m AS (SELECT row, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM dw JOIN w USING (word) JOIN g USING (bucket) GROUP BY row),
x AS (SELECT d.row, d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
        + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN m USING (row)),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (row)
"""


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"), longest=5, least=100, percent=100, first=2000)


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) r(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g),
c AS MATERIALIZED (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 100),
parts AS MATERIALIZED (SELECT lang, array_to_string(g, ' ') AS part, f FROM f WHERE f >= 100),
ends AS MATERIALIZED (SELECT lang, g, k, a, j, array_to_string(g[1 : j], ' ') AS head, array_to_string(g[j + 1 : k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
cuts AS (SELECT e.lang, e.g, e.k, e.a, j, l.f AS l, r.f AS r, s.n, (1000 * CAST(e.a AS HUGEINT) * CAST(s.n AS HUGEINT)) // (CAST(l.f AS HUGEINT) * CAST(r.f AS HUGEINT)) AS score
         FROM ends e JOIN parts l ON l.lang = e.lang AND l.part = e.head JOIN parts r ON r.lang = e.lang AND r.part = e.tail JOIN s ON s.lang = e.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inner_of AS (SELECT lang, g[i : i + m - 1] AS g, max(a) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY ALL),
kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, n, score FROM best b LEFT JOIN inner_of o ON o.lang = b.lang AND o.g = b.g WHERE coalesce(100 * o.longer < 100 * a, true))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""


def queries() -> dict:
    found = (
        op1_topk_bitsliced, op2_toxicity_svm, op3_minhash_neardup, op4_bloom_lm, op5_mix_sources, op6_warc_roundtrip, op7_quality_subwords, op8_winnow_decontaminate,
        op9_language_ftrl, op10_recompression_dedup, op11_url_filters, op12_importance_resampling, op13_phrase_collocations,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk_bitsliced": OP1_SQL, "op5_mix_sources": OP5_SQL, "op6_warc_roundtrip": OP6_SQL, "op8_winnow_decontaminate": OP8_SQL, "op10_recompression_dedup": OP10_SQL,
        "op11_url_filters": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_phrase_collocations": OP13_SQL,
    }
