"""Queries over conversation memory: store, tokens, search, ranking, assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as T

from ..operators import assembly, ranking, search, store
from . import inputs as I
from .registry import query

_N = 6


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, _N) for n in names})


@query("conversation_stats", f"""WITH {I.MESSAGES}, {I.COMPACTIONS},
m AS (SELECT conversation_id, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens, max(created_at) AS last_message_at FROM messages GROUP BY 1),
c AS (SELECT conversation_id, count(DISTINCT event_id) AS compactions, max(created_at) AS last_compaction_at FROM compactions GROUP BY 1)
SELECT m.*, coalesce(c.compactions, 0) AS compactions, c.last_compaction_at FROM m LEFT JOIN c USING (conversation_id)""")
def conversation_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.conversation_stats(I.messages(spark, d), I.compactions(spark, d))


@query("store_stats", f"""WITH {I.MESSAGES}, {I.COMPACTIONS} SELECT count(DISTINCT conversation_id) AS conversations, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens, (SELECT count(*) FROM compactions) AS compactions FROM messages""")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.store_stats(I.messages(spark, d), I.compactions(spark, d))


@query("list_conversations", f"""WITH {I.MESSAGES} SELECT conversation_id, min(created_at) AS created_at, max(created_at) AS updated_at FROM messages GROUP BY 1 ORDER BY updated_at DESC, conversation_id LIMIT 100 OFFSET 10""")
def list_conversations(spark: SparkSession, d: str) -> DataFrame:
    rows = I.messages(spark, d).groupBy("conversation_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    return store.list_conversations(rows, 100, 10)


@query("conversation_counters", f"""WITH {I.MESSAGES}, c AS (SELECT DISTINCT o_custkey AS conversation_id FROM orders)
SELECT c.conversation_id, count(m.message_id) AS message_count, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens, max(created_at) AS last_message_at FROM c LEFT JOIN messages m USING (conversation_id) GROUP BY 1""")
def conversation_counters(spark: SparkSession, d: str) -> DataFrame:
    return store.with_counters(I.table(spark, d, "orders").select(F.col("o_custkey").alias("conversation_id")).distinct(), I.messages(spark, d))


@query("add_messages", f"""WITH {I.MESSAGES}, last AS (SELECT conversation_id, max(sequence_num) AS last FROM messages GROUP BY 1),
n AS (SELECT user_id AS conversation_id, event_id, event_type AS content, (epoch_us(ts) // 1000) AS created_at, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM events)
SELECT concat('msg-', n.conversation_id, '-', coalesce(last, -1) + turn) AS message_id, n.conversation_id, 'user' AS role, content, CAST(1 AS BIGINT) AS tokens, CAST(coalesce(last, -1) + turn AS INTEGER) AS sequence_num, created_at FROM n LEFT JOIN last USING (conversation_id)
UNION ALL SELECT message_id, conversation_id, role, content, tokens, sequence_num, created_at FROM messages""")
def add_messages(spark: SparkSession, d: str) -> DataFrame:
    new = I.table(spark, d, "events").select(F.col("user_id").alias("conversation_id"), F.col("event_id").alias("position"), F.lit("user").alias("role"), F.col("event_type").alias("content"), F.lit(1).cast("long").alias("tokens"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"))
    return store.add_messages(I.messages(spark, d), new)


@query("conversation_messages", f"WITH {I.MESSAGES} SELECT * FROM messages WHERE conversation_id = 5 ORDER BY sequence_num LIMIT 3 OFFSET 1")
def conversation_messages(spark: SparkSession, d: str) -> DataFrame:
    return store.conversation_messages(I.messages(spark, d), 5, 3, 1)


@query("update_conversations", """SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'ordered' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer""")
def update_conversations(spark: SparkSession, d: str) -> DataFrame:
    changes = I.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("c_mktsegment", F.lit("ordered"))
    return store.overlay(I.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), changes, "c_custkey")


_GONE = "SELECT message_id FROM messages WHERE role = 'assistant' AND tokens > 50"


@query("delete_messages", f"WITH {I.MESSAGES} SELECT * FROM messages WHERE message_id NOT IN ({_GONE})")
def delete_messages(spark: SparkSession, d: str) -> DataFrame:
    m = I.messages(spark, d)
    return store.delete_messages(m, m.where("role = 'assistant' AND tokens > 50").select("message_id"))[0]


@query("deleted_totals", f"WITH {I.MESSAGES} SELECT conversation_id, count(*) AS removed, CAST(sum(tokens) AS BIGINT) AS removed_tokens FROM messages WHERE message_id IN ({_GONE}) GROUP BY 1")
def deleted_totals(spark: SparkSession, d: str) -> DataFrame:
    m = I.messages(spark, d)
    return store.delete_messages(m, m.where("role = 'assistant' AND tokens > 50").select("message_id"))[1]


@query("compaction_history", f"WITH {I.COMPACTIONS} SELECT * FROM compactions WHERE conversation_id = 7")
def compaction_history(spark: SparkSession, d: str) -> DataFrame:
    return store.compaction_history(I.compactions(spark, d), 7)


@query("mark_compacted", f"WITH {I.MESSAGES}, {I.COMPACTIONS} SELECT DISTINCT conversation_id, conversation_id IN (SELECT conversation_id FROM compactions) AS compacted FROM messages")
def mark_compacted(spark: SparkSession, d: str) -> DataFrame:
    return store.mark_compacted(I.messages(spark, d).select("conversation_id", F.lit(False).alias("compacted")).distinct(), I.compactions(spark, d))


@query("recent_messages", f"WITH {I.MESSAGES} SELECT m.*, c_name AS session_key, c_mktsegment AS title FROM messages m JOIN customer ON c_custkey = conversation_id")
def recent_messages(spark: SparkSession, d: str) -> DataFrame:
    c = I.table(spark, d, "customer").select(F.col("c_custkey").alias("conversation_id"), F.col("c_name").alias("session_key"), F.col("c_mktsegment").alias("title"))
    return store.recent_messages(I.messages(spark, d), c)


@query("settings_last_write", "SELECT user_id AS key, arg_max(event_type, event_id) AS value, max(event_id) AS updated_at FROM events GROUP BY 1")
def settings_last_write(spark: SparkSession, d: str) -> DataFrame:
    return store.last_write(I.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("updated_at")))


@query("list_findings", """SELECT o_orderkey AS id, o_orderpriority AS domain, o_orderstatus AS status, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY created_at DESC, id LIMIT 50""")
def list_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = I.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("domain"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return store.newest(rows, "F", "1-URGENT", 50)


@query("last_researched", "SELECT event_type AS target, max(ts) AS last_researched FROM events GROUP BY 1")
def last_researched(spark: SparkSession, d: str) -> DataFrame:
    return store.last_researched(I.table(spark, d, "events").select(F.col("event_type").alias("target"), F.col("ts").alias("created_at")))


@query("aggregate_stats", f"WITH {I.MESSAGES} SELECT role AS user_id, count(DISTINCT conversation_id) AS conversations, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens FROM messages GROUP BY 1")
def aggregate_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.aggregate_stats(I.messages(spark, d).withColumn("user_id", F.col("role"))).select("user_id", "conversations", "messages", "tokens")


@query("token_counts", """SELECT doc_id, family, CAST(ceil(length(text) / CASE WHEN family IN ('gpt', 'gemini', 'llama') THEN 4.0 ELSE 3.5 END) AS BIGINT) AS tokens,
CAST(ceil(length(text) / CASE WHEN family = 'claude' THEN 3.5 ELSE 4.0 END) AS BIGINT) AS estimate FROM documents, (SELECT unnest(['claude', 'gpt', 'gemini', 'llama', 'unknown']) AS family)""")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = I.table(spark, d, "documents").select("doc_id", "text", F.explode(F.array(*(F.lit(f) for f in T.FAMILIES))).alias("family"))
    return rows.select("doc_id", "family", T.token_count(F.col("text"), F.col("family")).alias("tokens"), T.estimate_tokens(F.col("text"), F.col("family")).alias("estimate"))


@query("token_cache", """SELECT sha256(text) AS content_hash, 'gpt' AS family, CAST(max(ceil(length(text) / 4.0)) AS BIGINT) AS count FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src1') GROUP BY 1""")
def token_cache(spark: SparkSession, d: str) -> DataFrame:
    rows = I.table(spark, d, "documents").select(F.col("text").alias("content"), F.lit("gpt").alias("model_family"), "source")
    old = rows.where("source = 'src1'")
    empty = spark.createDataFrame([], "content_hash string, family string, count long")
    return T.new_cache_rows(rows, T.new_cache_rows(old, empty))


@query("token_cache_stats", "SELECT lang AS family, count(DISTINCT text) AS entries FROM documents GROUP BY 1")
def token_cache_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = I.table(spark, d, "documents").select(F.col("text").alias("content"), F.col("lang").alias("model_family"))
    return T.cache_stats(T.new_cache_rows(rows, spark.createDataFrame([], "content_hash string, family string, count long")))


@query("model_families", """SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%claude%' THEN 'claude' WHEN lower(p_name) LIKE '%gpt%' OR lower(p_name) LIKE '%openai%' THEN 'gpt' WHEN lower(p_name) LIKE '%gemini%' THEN 'gemini' WHEN lower(p_name) LIKE '%llama%' THEN 'llama' ELSE 'unknown' END AS family FROM part""")
def model_families(spark: SparkSession, d: str) -> DataFrame:
    return I.table(spark, d, "part").select("p_partkey", T.model_family(F.col("p_name")).alias("family"))


@query("format_tokens", """SELECT doc_id, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 1000000 THEN printf('%.1fK', n / 1000.0) ELSE printf('%.1fM', n / 1000000.0) END AS shown FROM (SELECT doc_id, n_chars * 40 + 1 AS n FROM documents)""")
def format_tokens(spark: SparkSession, d: str) -> DataFrame:
    return I.table(spark, d, "documents").select("doc_id", T.format_tokens(F.col("n_chars") * 40 + 1).alias("shown"))


_ACCENTS = "translate(lower(content), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
_WORDS = f"list_filter(regexp_split_to_array({_ACCENTS}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_BM25 = f"""WITH {I.MESSAGES}, counted AS (SELECT *, {_WORDS} AS words FROM messages),
tf AS (SELECT * EXCLUDE (words), len(words) AS length, len(list_filter(words, lambda w: w = 'the')) AS a, len(list_filter(words, lambda w: w = 'that')) AS b FROM counted),
n AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM tf),
idf AS (SELECT *, CASE WHEN n > 2 * da THEN ln((n - da + 0.5) / (da + 0.5)) ELSE 1e-6 END AS ia, CASE WHEN n > 2 * db THEN ln((n - db + 0.5) / (db + 0.5)) ELSE 1e-6 END AS ib FROM n),
hits AS (SELECT tf.*, ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / mean)) + ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * length / mean)) AS bm25 FROM tf, idf WHERE a > 0 AND b > 0)"""


@query("search_bm25", _BM25 + " SELECT message_id, conversation_id, round(bm25, 6) AS bm25 FROM hits")
def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Every match with its score: words without stemming."""
    return _r(search.bm25(I.messages(spark, d), "the that", stemmed=False).select("message_id", "conversation_id", "bm25"), "bm25")


_SPARSE = _BM25 + f""", best AS (SELECT * FROM hits ORDER BY bm25 DESC, message_id LIMIT 20),
scored AS (SELECT *, 1 / (1 + bm25) AS sparse_score, exp(-({I.AS_OF} - created_at) / 2592000000.0::DOUBLE) AS recency_score FROM best)"""


@query("search_sparse", _SPARSE + " SELECT message_id, round(sparse_score, 6) AS sparse_score, round(recency_score, 6) AS recency_score, round(0.5 * sparse_score + 0.2 * recency_score, 6) AS score FROM scored")
def search_sparse(spark: SparkSession, d: str) -> DataFrame:
    found = search.sparse_search(I.messages(spark, d), "the that", I.AS_OF, stemmed=False)
    return _r(found.select("message_id", "sparse_score", "recency_score", "score"), "sparse_score", "recency_score", "score")


@query("search_filtered", _BM25 + f""", best AS (SELECT * FROM hits WHERE role = 'user' AND tokens >= 20 AND created_at BETWEEN {I.START} AND {I.START + 200 * 3_600_000} ORDER BY bm25 DESC, message_id LIMIT 10)
SELECT message_id, round(0.5 * bm25 / (1 + bm25) + 0.2 * exp(-({I.AS_OF} - created_at) / 2592000000.0::DOUBLE), 6) AS score FROM best""")
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    found = search.sparse_search(I.messages(spark, d), "the that", I.AS_OF, limit=10, mode="bm25", stemmed=False, roles=["user"], min_tokens=20, since=I.START, until=I.START + 200 * 3_600_000)
    return _r(found.select("message_id", "score"), "score")


@query("search_similar")
def search_similar(spark: SparkSession, d: str) -> DataFrame:
    return search.find_similar(I.messages(spark, d), "m1-0", I.AS_OF, stemmed=False).select("message_id", "score")


@query("postings", f"""WITH {I.MESSAGES}, w AS (SELECT message_id, len({_WORDS}) AS length, unnest({_WORDS}) AS term FROM messages) SELECT term, message_id, length, count(*) AS tf FROM w GROUP BY ALL""")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(I.messages(spark, d), stemmed=False)


@query("message_context", f"""WITH {I.MESSAGES} SELECT m.*, t.message_id AS target_id FROM messages m JOIN messages t ON m.conversation_id = t.conversation_id AND t.role = 'user' AND m.sequence_num BETWEEN t.sequence_num - 2 AND t.sequence_num + 2""")
def message_context(spark: SparkSession, d: str) -> DataFrame:
    m = I.messages(spark, d)
    return search.message_context(m, m.where("role = 'user'").select("message_id"))


@query("rank_rrf", f"""WITH {I.LISTS}, f AS (SELECT query_id, item_id, sum(1.0::DOUBLE / (60 + pos + 1)) AS score, min(pos) FILTER (list_no = 0) AS first FROM lists GROUP BY 1, 2)
SELECT query_id, item_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INTEGER) AS rank FROM f""")
def rank_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _r(ranking.rrf(I.lists(spark, d), by=["query_id"]), "score")


@query("rank_weighted_rrf", f"""WITH {I.LISTS}, f AS (SELECT query_id, item_id, sum(weight / 3.0 / (60 + pos + 1)) AS score, min(pos) FILTER (list_no = 0) AS first FROM lists GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INTEGER) AS rank FROM f)
SELECT query_id, item_id, round(score, 6) AS score, '0+1' AS sources, rank FROM r WHERE rank <= 20""")
def rank_weighted_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _r(ranking.weighted_rrf(I.lists(spark, d).withColumn("source", F.col("list_no").cast("string")), by=["query_id"]), "score")


@query("rank_weighted_average", f"""WITH {I.LISTS}, s AS (SELECT *, min(score) OVER w AS low, max(score) OVER w AS high FROM lists WINDOW w AS (PARTITION BY query_id, list_no)),
f AS (SELECT query_id, item_id, sum(weight * CASE WHEN high > low THEN (score - low) / (high - low) ELSE score END) / sum(weight) AS score FROM s GROUP BY 1, 2)
SELECT query_id, item_id, round(score, 6) AS score FROM f""")
def rank_weighted_average(spark: SparkSession, d: str) -> DataFrame:
    return _r(ranking.weighted_average(I.lists(spark, d), by=["query_id"]).select("query_id", "item_id", "score"), "score")


@query("rank_decay", f"""WITH {I.RANKED}, s AS (SELECT role, item_id, pos, score * exp(-({I.AS_OF} - created_at) * ln(2.0) / 2592000000.0::DOUBLE) AS score FROM ranked)
SELECT role, item_id, round(score, 6) AS score FROM s""")
def rank_decay(spark: SparkSession, d: str) -> DataFrame:
    return _r(ranking.temporal_decay(I.ranked(spark, d), I.AS_OF, by=["role"]).select("role", "item_id", "score"), "score")


@query("rank_diversity", f"""WITH {I.RANKED}, g AS (SELECT *, row_number() OVER (PARTITION BY role, conversation_id ORDER BY pos) - 1 AS earlier, count(*) OVER (PARTITION BY role, conversation_id) AS size FROM ranked),
s AS (SELECT *, score * (1 - 0.1 * earlier / max(size) OVER (PARTITION BY role)) AS adjusted FROM g)
SELECT role, item_id, earlier AS conversation_group, pos + 1 AS original_rank, round(adjusted, 6) AS score FROM s""")
def rank_diversity(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.diversify(I.ranked(spark, d), by=["role"])
    return _r(out.select("role", "item_id", F.col("conversation_group").cast("long").alias("conversation_group"), F.col("original_rank").cast("long").alias("original_rank"), "score"), "score")


@query("rank_top_per_conversation", f"""WITH {I.RANKED}, t AS (SELECT *, row_number() OVER (PARTITION BY role, conversation_id ORDER BY pos) AS n FROM ranked)
SELECT role, item_id, conversation_id, CAST(row_number() OVER (PARTITION BY role ORDER BY pos) AS INTEGER) AS rank FROM t WHERE n <= 3""")
def rank_top_per_conversation(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_per_conversation(I.ranked(spark, d), by=["role"]).select("role", "item_id", "conversation_id", "rank")


@query("rank_mrr", f"""WITH {I.LISTS}, hit AS (SELECT query_id, min(pos) AS pos FROM lists JOIN labels ON doc_id = item_id AND toxic = 1 WHERE list_no = 0 GROUP BY 1)
SELECT q.query_id, round(coalesce(1.0::DOUBLE / (pos + 1), 0), 6) AS mrr FROM (SELECT DISTINCT query_id FROM lists) q LEFT JOIN hit USING (query_id)""")
def rank_mrr(spark: SparkSession, d: str) -> DataFrame:
    results = I.lists(spark, d).where("list_no = 0")
    relevant = results.join(I.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("item_id")), "item_id").select("query_id", "item_id")
    return _r(ranking.mrr(results, relevant, ["query_id"]), "mrr")


@query("rank_ndcg", f"""WITH {I.LISTS}, r AS (SELECT * FROM lists WHERE list_no = 0), j AS (SELECT source AS query_id, doc_id AS item_id, quality + 2 * toxic AS relevance FROM labels JOIN documents USING (doc_id)),
n AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1), g AS (SELECT query_id, sum(relevance / log2(pos + 2.0::DOUBLE)) AS gain FROM r JOIN j USING (query_id, item_id) GROUP BY 1),
o AS (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, item_id) - 1 AS p FROM j), i AS (SELECT query_id, sum(relevance / log2(p + 2.0::DOUBLE)) AS ideal FROM o JOIN n USING (query_id) WHERE p < n GROUP BY 1)
SELECT query_id, round(CASE WHEN coalesce(ideal, 0) > 0 THEN coalesce(gain, 0) / ideal ELSE 0 END, 6) AS ndcg FROM n LEFT JOIN g USING (query_id) LEFT JOIN i USING (query_id)""")
def rank_ndcg(spark: SparkSession, d: str) -> DataFrame:
    judged = I.table(spark, d, "labels").join(I.table(spark, d, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item_id"), (F.col("quality") + 2 * F.col("toxic")).alias("relevance"))
    return _r(ranking.ndcg(I.lists(spark, d).where("list_no = 0"), judged, ["query_id"]), "ndcg")


@query("rank_explain", f"""WITH {I.RANKED} SELECT role, item_id, printf('Score: %.4f | Recency: %.4f', score * 0.7 + 0.00001, score / 3) AS text FROM ranked""")
def rank_explain(spark: SparkSession, d: str) -> DataFrame:
    rows = I.ranked(spark, d)
    return rows.select("role", "item_id", ranking.explain(F.col("score") * 0.7 + 0.00001, F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("score") / 3).alias("text"))


@query("rank_best_across_queries")
def rank_best_across_queries(spark: SparkSession, d: str) -> DataFrame:
    return ranking.best_across_queries(I.ranked(spark, d).withColumnRenamed("role", "query_id"), I.AS_OF)


_PACKED = """packed AS (SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY conversation_id ORDER BY sequence_num DESC ROWS UNBOUNDED PRECEDING) AS running FROM messages WHERE role <> 'system') WHERE running <= 200)"""


@query("assemble_recent", f"WITH {I.MESSAGES}, {_PACKED} SELECT * EXCLUDE (running) FROM packed")
def assemble_recent(spark: SparkSession, d: str) -> DataFrame:
    return assembly.recent(I.messages(spark, d), 200, include_system=False)


@query("assemble_full", f"WITH {I.MESSAGES} SELECT * FROM messages WHERE role <> 'system'")
def assemble_full(spark: SparkSession, d: str) -> DataFrame:
    return assembly.full(I.messages(spark, d))


@query("assembly_metadata", f"""WITH {I.MESSAGES}, {_PACKED}, p AS (SELECT conversation_id, CAST(sum(tokens) AS BIGINT) AS total_tokens, count(*) AS included FROM packed GROUP BY 1)
SELECT conversation_id, coalesce(total_tokens, 0) AS total_tokens, round(coalesce(total_tokens, 0) / 200.0::DOUBLE, 6) AS used, 200 - coalesce(total_tokens, 0) AS remaining, coalesce(included, 0) AS included, n AS messages, coalesce(included, 0) < n AS truncated
FROM (SELECT conversation_id, count(*) AS n FROM messages GROUP BY 1) LEFT JOIN p USING (conversation_id)""")
def assembly_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = I.messages(spark, d)
    return _r(assembly.metadata(assembly.recent(m, 200, include_system=False), m, 200), "used")


@query("estimate_message_count", f"WITH {I.MESSAGES}, {_PACKED.replace(' WHERE role <> ' + chr(39) + 'system' + chr(39), '')} SELECT conversation_id, count(*) AS messages FROM packed GROUP BY 1")
def estimate_message_count(spark: SparkSession, d: str) -> DataFrame:
    return assembly.estimate_message_count(I.messages(spark, d), 200)


@query("assemble_relevant")
def assemble_relevant(spark: SparkSession, d: str) -> DataFrame:
    return assembly.assemble(I.messages(spark, d), "relevant", 500, I.AS_OF, 98, "the that", stemmed=False)


@query("assemble_hybrid")
def assemble_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return assembly.assemble(I.messages(spark, d), "hybrid", 500, I.AS_OF, 98, "the that", stemmed=False)


@query("conversation_summary", f"""WITH {I.MESSAGES}, b AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence_num DESC) AS back FROM messages)
SELECT conversation_id, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens, strftime(make_timestamp(max(created_at) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_active,
string_agg(role || ': ' || substr(content, 1, 100), chr(10) ORDER BY sequence_num) FILTER (back <= 3) AS recent FROM b GROUP BY 1""")
def conversation_summary(spark: SparkSession, d: str) -> DataFrame:
    return assembly.summary(I.messages(spark, d))


@query("export_rows", f"WITH {I.MESSAGES} SELECT conversation_id, role, content, created_at AS timestamp, tokens FROM messages")
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    return I.messages(spark, d).select("conversation_id", "role", "content", F.col("created_at").alias("timestamp"), "tokens")


