"""One query per operator, over whole tables with production parameters, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import audit, bpe, decontaminate, jaccard, langid, manifest, media, mixing, packing, quality, secrets, sharding, tokencount


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_documents(spark, sf_dir))


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(_documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_documents(spark, sf_dir), with_ids=False)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cascade(_documents(spark, sf_dir)).drop("rejected_by")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = langid.identify(docs, langid.train(docs), keep=["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_documents(spark, sf_dir))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(_documents(spark, sf_dir))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("row.doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_documents(spark, sf_dir), manifest.tampering())


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_media_columns, op3_token_packing, op4_jaccard_join, op5_byte_bpe, op6_quality_rules, op7_language_id, op8_token_counts, op9_hilbert_shards, op10_source_mix, op11_filter_audit, op12_benchmark_decontamination, op13_merkle_manifest)}

SQL = {
    "op4_jaccard_join": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM docs),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
grams AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS o
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * o >= 75 * (nx + ny - o)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.y FROM reach r JOIN both_ways l ON r.b = l.x)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, CAST(m.c AS BIGINT) AS component_id
FROM sized s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = s.doc_id
""",
    "op6_quality_rules": r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
places AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM places) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY doc_id),
measured AS (
  SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    len(string_split(t, chr(10))) AS n_lines, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-*•] '))) AS n_bullets,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) AS n_plain
  FROM docs LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    word_chars < 2 * n_words OR word_chars > 25 * n_words OR n_symbols * 10 > n_words * 3 OR n_dup_lines * 2 > n_lines
    OR length(regexp_replace(t, '\P{L}+', '', 'g')) * 2 < word_chars OR length(regexp_replace(t, '\P{Lu}+', '', 'g')) * 10 > word_chars * 6
    OR (n_bullets * 10 > n_lines * 9 AND n_lines > 3) OR n_plain * 2 > n_words AS rejected
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged
""",
    "op11_filter_audit": r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM docs GROUP BY t),
known AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS bad FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < d.doc_id THEN 16 ELSE 0 END AS failed
  FROM docs d JOIN firsts USING (t) LEFT JOIN known k ON k.doc_id = d.doc_id),
sets AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a JOIN letters b ON b.b <> a.b JOIN letters c ON c.b NOT IN (a.b, b.b) JOIN letters d ON d.b NOT IN (a.b, b.b, c.b) JOIN letters e ON e.b NOT IN (a.b, b.b, c.b, d.b)),
steps AS (SELECT filter_order, s AS step, bits[s] AS b, CAST(coalesce(list_sum(bits[:s - 1]), 0) AS INTEGER) AS before FROM orders, (SELECT unnest(range(1, 6)) AS s)),
found AS (
  SELECT part, filter_order, step, b, sum(CASE WHEN failed & (before | b) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failed & before = 0 AND failed & b <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed & before <> 0 AND failed & b <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = b THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed & before = 0 AND failed & b <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed & before = 0 AND failed & b <> 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM sets, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
FROM found
""",
    "op12_benchmark_decontamination": r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size),
found AS (SELECT r, i, p.size, item FROM (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS t FROM places) p JOIN windows USING (size, t)),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + size)) AS j FROM (SELECT DISTINCT r, i, size FROM found)) GROUP BY r),
owners AS (SELECT r, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(o.n, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered c USING (r) LEFT JOIN owners o USING (r)
""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
      lambda a, b: list_reduce([xor(a, b)] || range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS crc
  FROM documents),
hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS now
  FROM docs),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM hashed)),
rows AS (SELECT l.*, t FROM leaves l JOIN langs ON l.lang IS NOT DISTINCT FROM langs.lang),
up(t, l, i, n, d) AS (
  SELECT t, 0, i, n, leaf FROM rows
  UNION ALL SELECT t, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY t, l, n, i // 2),
top(l, i, n, d) AS (
  SELECT 0, up.t, langs.n, d FROM up JOIN langs USING (t) WHERE up.n = 1
  UNION ALL SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY l, n, i // 2),
climb(doc_id, leaf, t, l, i, n, d, p) AS (
  SELECT doc_id, leaf, t, 0, i, n, coalesce(now, leaf), '' FROM rows
  UNION ALL
  SELECT c.doc_id, c.leaf, c.t, c.l + 1, c.i // 2, (c.n + 1) // 2, sha256(CASE WHEN c.i % 2 = 0 THEN c.d || coalesce(u.d, '') ELSE u.d || c.d END), p || coalesce(u.d, '')
  FROM climb c LEFT JOIN up u ON u.t = c.t AND u.l = c.l AND u.i = xor(c.i, 1) WHERE c.n > 1),
onward(doc_id, leaf, t, l, i, n, d, p) AS (
  SELECT doc_id, leaf, c.t, 0, c.t, langs.n, d, p FROM climb c JOIN langs ON langs.t = c.t WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.t, c.l + 1, c.i // 2, (c.n + 1) // 2, sha256(CASE WHEN c.i % 2 = 0 THEN c.d || coalesce(u.d, '') ELSE u.d || c.d END), p || coalesce(u.d, '')
  FROM onward c LEFT JOIN top u ON u.l = c.l AND u.i = xor(c.i, 1) WHERE c.n > 1)
SELECT doc_id, leaf, s.d AS subroot, r.d AS root, sha256(p) AS proof_sha256, o.d AS folded_root, o.d = r.d AS verified
FROM onward o JOIN top s ON s.l = 0 AND s.i = o.t JOIN top r ON r.n = 1 WHERE o.n = 1
""",
}
