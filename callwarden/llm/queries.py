"""One registered query for each operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.llm import audit, covertree, fingerprint, language, mainpart, minhash, mixing, packing, pii, ranking, suffix, toxicity, urls
from callwarden.llm.common import crc_bucket, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, similarity=(80, 100))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = language.identify(docs, language.train(language.held_out(docs)))
    held = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(True))
    return labelled.select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.split_out(table(spark, sf_dir, "labels"), folds=4, held=2))
    held = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, capacity=4096)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_mainpart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainpart.extract(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_minhash, op2_language, op3_suffix, op4_fingerprint, op5_mixing, op6_covertree, op7_toxicity, op8_urls,
                                   op9_packing, op10_pii, op11_audit, op12_ranking, op13_mainpart, pipeline)}

_COMPONENTS = """
reach AS (SELECT node, node AS other FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a)"""

ORACLES = {
    "op1_minhash": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
nodes AS (SELECT doc_id AS node FROM documents),{_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) c ON c.node = d.doc_id""",
    "op5_mixing": """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h FROM documents),
sources AS (
  SELECT source, source_size, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
levels AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weight
  FROM sources WINDOW before AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, 3 * source_size * weight < w * rest AS full_up FROM levels),
water AS (SELECT (SELECT sum(source_size) FROM sources) - coalesce(sum(3 * source_size) FILTER (full_up), 0) AS rest, sum(w) FILTER (NOT full_up) AS weight FROM capped),
targets AS (
  SELECT source, source_size, CASE WHEN full_up THEN (3 * source_size)::DOUBLE ELSE (w * water.rest)::DOUBLE / water.weight::DOUBLE END AS target
  FROM capped, water),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS whole FROM targets),
steps AS (
  SELECT p.source, s.h, sum(s.size) AS own, sum(sum(s.size)) OVER (PARTITION BY p.source ORDER BY s.h) AS upto, min(p.target - p.whole * p.source_size) AS budget
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source GROUP BY p.source, s.h),
border AS (
  SELECT source, CASE WHEN own < 2 * (budget - upto + own) THEN h + 1 ELSE h END AS below
  FROM steps WHERE budget > 0 AND upto >= budget QUALIFY row_number() OVER (PARTITION BY source ORDER BY h) = 1)
SELECT s.doc_id, s.size, p.source_size, p.target, s.size * (p.whole + CASE WHEN s.h < coalesce(b.below, 0) THEN 1 ELSE 0 END) AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN border b ON b.source IS NOT DISTINCT FROM p.source""",
    "op6_covertree": f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y
  ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.98),
nodes AS (SELECT vec_id AS node FROM embeddings),{_COMPONENTS}
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) c ON c.node = e.vec_id""",
    "op8_urls": """
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'),
         ('block', 'com', '/de/')) AS r(kind, h, p)),
best AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(kind, length(h || p)) AS kind
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(kind, 'allow') AS verdict, coalesce(kind, 'allow') = 'block' AS listed FROM parts LEFT JOIN best USING (page_id)""",
    "op11_audit": """
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM words LEFT JOIN marks USING (doc_id)),
sets AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM failing GROUP BY part, fails),
orders AS (
  SELECT '' AS o UNION ALL SELECT o || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS x(f) WHERE NOT contains(o, f)),
steps AS (SELECT o AS filter_order, k::INT AS step, substr(o, k, 1) AS filter FROM orders, range(1, 6) AS r(k) WHERE length(o) = 5),
hits AS (SELECT part, fails, n, good, toxic, o, coalesce((SELECT min(strpos(o, c)) FROM unnest(string_split(fails, '')) AS u(c) WHERE c <> ''), 9) AS gone
  FROM sets, orders WHERE length(o) = 5),
counted AS (
  SELECT part, filter_order, step, filter, sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone < step AND contains(fails, filter) THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = filter THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM hits JOIN steps ON o = filter_order GROUP BY part, filter_order, step, filter)
SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM counted""",
    "op12_ranking": """
WITH terms AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
held AS (SELECT * FROM terms WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS size FROM held),
tf AS (SELECT doc_id, len(w)::BIGINT AS n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM held) GROUP BY doc_id, w, t),
wanted AS (SELECT item_id, t, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
weights AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS weight FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), totals),
scores AS (
  SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // size))))::BIGINT AS score
  FROM wanted JOIN weights USING (t) JOIN tf USING (t), totals GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10""",
}
