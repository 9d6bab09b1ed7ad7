"""The registered queries over the dealt operators, with their SQL checks where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm import bpe, decontam, divergence, fuzzy_lines, langid, licences, near_docs, pii, ranked, topk, url_rules, vectors
from folioweave.llm import token_counts as counts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` computes the same rows in DuckDB."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


NEAR_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, [w FOR w IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS w
  FROM documents),
runs AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM runs a JOIN runs b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents
  UNION
  SELECT reach.d, edges.b FROM reach JOIN edges ON edges.a = reach.r),
least AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least ON d = doc_id LEFT JOIN sizes USING (doc_id)
"""


@query("op6_near_documents", NEAR_SQL)
def near_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the smallest doc_id of its group of near copies (Jaccard 0.85 over five-word runs)."""
    return near_docs.near_duplicates(table(spark, folder, "documents"), similarity=0.85)


LEAKS_SQL = r"""
WITH d AS (
  SELECT doc_id, [w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF w <> ''] AS w
  FROM documents),
b AS (
  SELECT item_id, [w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF w <> ''] AS w
  FROM benchmark),
tests AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
runs AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM places, (SELECT DISTINCT n FROM tests) WHERE i + n - 1 <= len(w)),
found AS (SELECT doc_id, i, runs.n, item_id FROM runs JOIN tests ON runs.n = tests.n AND runs.s = tests.s),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query("op8_decontamination", LEAKS_SQL)
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its words inside verbatim passages of the benchmark (ten words or more)."""
    found = decontam.contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("found.items", lambda i: i.cast("string"))), ",")
    n_hit = decontam.span_words(F.col("found.spans"))
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op1_personal_data")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal data: counts and digest of the base spans, and all spans."""
    found = pii.personal_data(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(pii.shown("base").cast("binary"), 256).alias("base_sha256"), pii.shown("spans").alias("spans"))


VECTORS_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach AS (
  SELECT vec_id AS d, vec_id AS r FROM embeddings
  UNION
  SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON d = vec_id LEFT JOIN counts ON a = vec_id
"""


@query("op3_near_vectors", VECTORS_SQL)
def near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding with the number of its links at a cosine of 0.93 within its label, and its group."""
    return vectors.near_vectors(table(spark, folder, "embeddings"), threshold=0.93)


@query("op4_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its bytes and tokens, and whether it is over 2,048 tokens."""
    counted = counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


@query("op9_bpe")
def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the number and digest of its token ids and the digest of the text decoded from them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op10_language")
def language(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its most probable language, learned from four fifths of the documents."""
    docs = table(spark, folder, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~out).select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


URLS_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT u.page_id, max_by(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
    max_by(rules.verdict, length(rules.host || rules.path)) AS verdict
  FROM u JOIN rules ON (u.host = rules.host OR u.host LIKE '%.' || rules.host) AND starts_with(u.path, rules.path)
  GROUP BY u.page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host || path,
  '(^|[^A-Za-z0-9])(bets|betting|bingo|casino|jackpot|lottery|malware|phishing|pills|poker|porn|torrent|warez|xxx)($|[^A-Za-z0-9])')
  THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (page_id)
"""


@query("op5_url_filter", URLS_SQL)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with its host, path, deciding rule and verdict."""
    rules = url_rules.host_rules(spark, url_rules.FIXED_RULES).union(url_rules.word_rules(spark, url_rules.BLOCKED_WORDS))
    return url_rules.judge_urls(table(spark, folder, "pages"), rules)


@query("op2_licences")
def licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its licence, its own or that of its nearest directory.

    Documents have no paths; they are filed by source, thousands and tens, and every tenth is its directory's LICENSE file.
    """
    docs = table(spark, folder, "documents")
    n = F.col("doc_id")
    name = F.when(n % 1000 == 0, F.lit("LICENSE")).when(n % 10 == 0, F.concat_ws("/", F.floor(n / 10), F.lit("LICENSE"))).otherwise(
        F.concat_ws("/", F.floor(n / 10), n))
    found = licences.scan_licences(docs.select(F.concat_ws("/", "source", F.floor(n / 1000), name).alias("path"), "text"))
    return found


@query("op7_fuzzy_lines")
def fuzzy_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its lines, how many of them repeat a line kept elsewhere, and the digest of what is left."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = fuzzy_lines.drop_lines(docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")), fuzzy_lines.repeated_lines(docs))
    return cut.select(
        "doc_id", "n_lines", F.col("dropped_lines").cast("long").alias("n_dropped"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


SOURCES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
found AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
sizes AS (SELECT lang, source, sum(n) AS n FROM found GROUP BY 1, 2),
groups AS (
  SELECT g.lang, g.source, coalesce(sizes.n, 0) AS n, coalesce(langs.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN sizes USING (lang, source) LEFT JOIN langs ON langs.lang = g.lang),
shares AS (
  SELECT groups.lang, groups.source, kept.term, coalesce(found.n, 0) AS count,
    1 + (1000000000::HUGEINT * (coalesce(found.n, 0) + 5)) // (groups.n + 5 * groups.v)::HUGEINT AS p
  FROM groups JOIN kept ON kept.lang = groups.lang
  LEFT JOIN found ON found.lang = groups.lang AND found.source = groups.source AND found.term = kept.term),
whole AS (
  SELECT kept.lang, kept.term, 1 + (1000000000::HUGEINT * (kept.n + 5)) // (langs.n + 5 * langs.v)::HUGEINT AS q FROM kept JOIN langs USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT shares.lang, source, 'term', shares.term, (p - q)::BIGINT
  FROM shares JOIN whole ON whole.lang = shares.lang AND whole.term = shares.term WHERE count > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query("op11_source_divergence", SOURCES_SQL)
def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Each source of a language against every other one, and the terms in which it exceeds the language most."""
    return divergence.audit_sources(table(spark, folder, "documents"), least_docs=30, smoothing=5, top=50)


TOP_SQL = r"""
WITH v AS (
  SELECT vec_id, [floor(1024 * x)::BIGINT FOR x IN embedding::DOUBLE[]] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e::DOUBLE[], b.e::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op12_top_vectors", TOP_SQL)
def top_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The ten embeddings with the highest integer inner product for every hundredth one."""
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


RANKED_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
sizes AS (SELECT r, count(*) AS n FROM d GROUP BY 1),
stats AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM sizes),
norms AS (SELECT r, 100 - 50 + (50 * n * nd) // l AS m FROM sizes, stats),
tfs AS (SELECT r, doc_id, term, count(*) AS tf FROM d SEMI JOIN i ON d.term = i.term GROUP BY 1, 2, 3),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, stats GROUP BY term, nd),
scores AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM i JOIN tfs USING (term) JOIN weights USING (term) JOIN norms USING (r) GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query("op13_ranked_search", RANKED_SQL)
def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty best documents for every benchmark item."""
    return ranked.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)
