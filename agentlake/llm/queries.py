"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard, langid, mixing, tokencount, tokens, toxicity, urlfilter, vectordedup, warc
from .common import settle, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return add


_OP3_SQL = r"""
WITH taken AS (
  SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
), cut AS (
  SELECT page_id, url,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '(/index\.html?|/+)$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS parts
  FROM taken
), keyed AS (
  SELECT page_id, url, host || path || CASE WHEN len(parts) > 0 THEN '?' || array_to_string(parts, '&') ELSE '' END AS canonical_url FROM cut
)
SELECT page_id, url, canonical_url FROM keyed
WHERE canonical_url <> '' AND canonical_url IN (SELECT canonical_url FROM keyed WHERE url LIKE '%utm_source=feed%')
"""

_OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, substr(md5(page_id || '|' || coalesce(url, '')), 1, 2) AS fault FROM pages WHERE page_id IS NOT NULL),
r AS (
  SELECT page_id, fault, E'WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: ' || url || E'\r\nContent-Length: ' || strlen(html) || E'\r\n\r\n' || html || E'\r\n\r\n' AS sound,
    E'WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: ' || url || E'\r\nContent-Length: ' || strlen(html) || E'\r\n\r\n' || substr(html, 1, length(html) - 1) || '~' || E'\r\n\r\n' AS damaged FROM p
), o AS (SELECT *, sum(strlen(sound)) OVER (ORDER BY page_id, sha256(sound) ROWS UNBOUNDED PRECEDING) - strlen(sound) AS begins FROM r)
SELECT begins::BIGINT AS "offset", sha256(sound) AS primary_hash, CASE WHEN fault = '00' THEN sha256(damaged) END AS replica_hash FROM o WHERE fault IN ('00', '01')
"""


@_query("op1_token_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.shards(table(spark, sf_dir, "documents"))


@_query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op3_url_filter", _OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that were also syndicated by feed: their canonical URL is that of a page with utm_source=feed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.matches(pages, pages.where("url LIKE '%utm_source=feed%'").select("url"))


@_query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@_query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


_OP7_SQL = r"""
WITH RECURSIVE t AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''),
g AS (SELECT text, min(doc_id) AS rep FROM t GROUP BY text),
w AS (SELECT rep, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS w FROM g),
s AS (SELECT rep, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [array_to_string(w, ' ')] END) AS grams FROM w WHERE len(w) > 0),
e AS (SELECT rep, len(grams) AS size, unnest(grams) AS gram FROM s),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.size) + any_value(b.size) AS sizes, count(*) AS both_have FROM e a JOIN e b ON a.gram = b.gram AND a.rep <> b.rep AND a.size >= 0.6 * b.size AND b.size >= 0.6 * a.size GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE both_have::DOUBLE / (sizes - both_have) >= 0.6 - 1e-12),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a AS rep, least(a, min(b)) AS class_id FROM r GROUP BY a),
m AS (SELECT rep, count(*) AS times FROM t JOIN g USING (text) GROUP BY rep),
n AS (SELECT l.a AS rep, sum(m.times) AS found FROM l JOIN m ON m.rep = l.b GROUP BY l.a)
SELECT d.doc_id, coalesce(k.class_id, g.rep, d.doc_id) AS class_id, (coalesce(n.found, 0) + coalesce(m.times, 1) - 1)::BIGINT AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN t USING (doc_id) LEFT JOIN g USING (text) LEFT JOIN m USING (rep) LEFT JOIN k USING (rep) LEFT JOIN n USING (rep)
"""


@_query("op7_ngram_jaccard", _OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its class of near copies and its number of links."""
    return jaccard.near_classes(table(spark, sf_dir, "documents"))


@_query("op8_section_tokens")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.section_tokens(table(spark, sf_dir, "documents"))


@_query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@_query("op10_warc_fixity", _OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica of all pages with faults put in place: of some records the last character is wrong, some are missing."""
    pages = table(spark, sf_dir, "pages")
    sound, fault = warc.record(F.col("url"), F.col("html")), F.substring(F.md5(F.concat(F.col("page_id").cast("string"), F.lit("|"), F.coalesce("url", F.lit("")))), 1, 2)
    damaged = F.replace(sound, F.col("html"), F.concat(F.expr("substring(html, 1, length(html) - 1)"), F.lit("~")))
    hashes = pages.select(F.col("page_id").alias("number"), F.sha2(sound, 256).alias("hash"), F.octet_length(sound).alias("bytes"), fault.alias("fault"), F.when(fault == "00", F.sha2(damaged, 256)).alias("damaged"))
    laid = settle(warc.laid_out(hashes).select("offset", "hash", "fault", "damaged"))
    replica = laid.where("fault != '01'").select("offset", F.when(F.col("fault") == "00", F.col("damaged")).otherwise(F.col("hash")).alias("hash"))
    return warc.audit(laid, replica)


_OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, min(embedding)::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id
), d AS (SELECT len(embedding) AS n FROM embeddings WHERE vec_id IN (SELECT vec_id FROM v) GROUP BY n ORDER BY count(*) DESC, n LIMIT 1),
s AS (SELECT vec_id, e FROM v WHERE len(e) = (SELECT n FROM d)),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM s x JOIN s y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a AS vec_id, least(a, min(b)) AS class_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(class_id, vec_id) AS class_id, coalesce(links, 0)::BIGINT AS links
FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id IS NOT NULL) LEFT JOIN k USING (vec_id) LEFT JOIN n USING (vec_id)
"""


@_query("op9_embedding_near_copies", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with its class of near copies and its number of links."""
    return vectordedup.near_classes(table(spark, sf_dir, "embeddings"))
