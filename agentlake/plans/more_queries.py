"""Queries over records, vectors by message, search with vectors, summaries' views, queues with processors and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, graph, preferences, ranking, records, search, summaries, updates, vectors
from ..operators import entities as E
from ..sources import adapters
from ..streaming import queues
from . import inputs as I
from .graph_queries import CHAT_MENTIONS, PER_CHAT
from .registry import query


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# Records

_GOALS = "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'active' END AS status, 5::BIGINT AS created_at, 5::BIGINT AS updated_at FROM orders"


def _goals(spark: SparkSession, d: str) -> DataFrame:
    o = I.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "active").alias("status"), F.lit(5).cast("long").alias("created_at"), F.lit(5).cast("long").alias("updated_at"))


@query("records_add", f"SELECT * FROM ({_GOALS}) UNION ALL SELECT 'c' || c_custkey, c_name, 'active', 9::BIGINT, 9::BIGINT FROM customer")
def records_add(spark: SparkSession, d: str) -> DataFrame:
    new = I.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("title"))
    return records.add(_goals(spark, d), new, 9, status="active")


@query("records_get", f"SELECT * FROM ({_GOALS}) WHERE id = '7'")
def records_get(spark: SparkSession, d: str) -> DataFrame:
    return records.get(_goals(spark, d), "7")


@query("records_update", f"""WITH g AS ({_GOALS}), c AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, max(l_returnflag) AS title FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT g.id, coalesce(c.title, g.title) AS title, g.status, g.created_at, CASE WHEN c.id IS NULL THEN g.updated_at ELSE 11 END AS updated_at FROM g LEFT JOIN c USING (id)""")
def records_update(spark: SparkSession, d: str) -> DataFrame:
    changes = I.table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.max("l_returnflag").alias("title"))
    return records.update(_goals(spark, d), changes, 11)


@query("records_remove", f"SELECT * FROM ({_GOALS}) WHERE id NOT IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R')")
def records_remove(spark: SparkSession, d: str) -> DataFrame:
    gone = I.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("id"))
    return records.remove(_goals(spark, d), gone)


@query("settings_map", "SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY 1")
def settings_map(spark: SparkSession, d: str) -> DataFrame:
    rows = I.table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("updated_at"))
    return records.settings_map(rows).select(F.explode("settings").alias("key", "value"))


@query("settings_set", "SELECT key, CASE key WHEN '1' THEN 'dark' ELSE value END AS value, CASE key WHEN '1' THEN 1000000000 ELSE updated_at END AS updated_at FROM (SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS value, max(event_id) AS updated_at FROM events GROUP BY 1)")
def settings_set(spark: SparkSession, d: str) -> DataFrame:
    rows = I.table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("updated_at"))
    return records.set_setting(rows, "1", "dark", 1_000_000_000)


_FINDINGS = "SELECT o_orderkey AS id, o_orderpriority AS domain, 'pending' AS status, 0::BIGINT AS presented_at, NULL::BIGINT AS acted_at, NULL::BIGINT AS dismissed_at FROM orders"


@query("findings_status", f"SELECT id, domain, CASE WHEN id % 3 = 0 THEN 'acted' ELSE status END AS status, presented_at, CASE WHEN id % 3 = 0 THEN 77 END::BIGINT AS acted_at, dismissed_at FROM ({_FINDINGS})")
def findings_status(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("long")
    rows = I.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("domain"), F.lit("pending").alias("status"), F.lit(0).cast("long").alias("presented_at"), none.alias("acted_at"), none.alias("dismissed_at"))
    return records.set_status(rows, rows.where("id % 3 = 0"), "acted", 77)


@query("research_history", "SELECT event_id AS id, event_type AS target, (epoch_us(ts) // 1000) AS created_at FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY created_at DESC, id LIMIT 50")
def research_history(spark: SparkSession, d: str) -> DataFrame:
    log = I.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("target"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"))
    return records.research_history(log, log.agg(F.min("target")).first()[0])


# Vectors by message

_VECTORS = "v AS (SELECT 'm' || vec_id AS message_id, embedding, 'p' || label % 3 AS provider FROM embeddings)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return I.table(spark, d, "embeddings").select(F.concat(F.lit("m"), F.col("vec_id").cast("string")).alias("message_id"), "embedding", F.concat(F.lit("p"), (F.col("label") % 3).cast("string")).alias("provider"))


def _mock(spark: SparkSession) -> vectors.EmbeddingGenerator:
    return vectors.EmbeddingGenerator()


@query("vector_has", f"WITH {_VECTORS} SELECT 'm' || doc_id AS message_id, 'm' || doc_id IN (SELECT message_id FROM v) AS has_embedding FROM documents")
def vector_has(spark: SparkSession, d: str) -> DataFrame:
    ids = I.table(spark, d, "documents").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("message_id"))
    return vectors.has_embedding(_vectors(spark, d), ids)


@query("vector_get", f"WITH {_VECTORS} SELECT unnest(embedding)::DOUBLE AS value FROM v WHERE message_id = 'm7'")
def vector_get(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(float(x),) for x in vectors.get_embedding(_vectors(spark, d), "m7") or []], "value double")


@query("vector_delete", f"WITH {_VECTORS} SELECT message_id, provider FROM v WHERE message_id NOT IN (SELECT 'm' || doc_id FROM labels WHERE toxic = 1)")
def vector_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = I.table(spark, d, "labels").where("toxic = 1").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("message_id"))
    return vectors.delete_embeddings(_vectors(spark, d), gone).select("message_id", "provider")


@query("vector_similar", f"WITH {_VECTORS}, q AS (SELECT embedding::DOUBLE[64] AS e FROM v WHERE message_id = 'm3'), b AS (SELECT message_id, array_distance(embedding::DOUBLE[64], e) AS distance FROM v, q WHERE message_id <> 'm3' ORDER BY distance, message_id LIMIT 10) SELECT message_id, round(distance, 6) AS distance, round(exp(-distance), 6) AS score FROM b")
def vector_similar(spark: SparkSession, d: str) -> DataFrame:
    return _r(vectors.find_similar(_vectors(spark, d), "m3"), "distance", "score")


@query("vector_by_text")
def vector_by_text(spark: SparkSession, d: str) -> DataFrame:
    """Messages embedded, then searched by the text of one of them: it is the nearest."""
    generator = _mock(spark)
    rows = I.messages(spark, d)
    own = rows.select("message_id", generator.column(F.col("content")).alias("embedding"))
    return vectors.search_by_text(own, rows.orderBy("message_id").first()["content"], generator)


@query("vector_rebuild", f"WITH {I.MESSAGES} SELECT count(*) AS done, 0::BIGINT AS failed FROM messages WHERE conversation_id % 2 = 1")
def vector_rebuild(spark: SparkSession, d: str) -> DataFrame:
    rows = I.messages(spark, d)
    return vectors.rebuild(rows, rows.where("conversation_id % 2 = 0").select("message_id"), _mock(spark))[1]


# Search with vectors and stems

_PLACED = "m AS (SELECT *, row_number() OVER (ORDER BY conversation_id, sequence_num) - 1 AS vec_id FROM messages)"


@query("search_hybrid", f"""WITH {I.MESSAGES}, {_PLACED}, w AS (SELECT *, regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+') AS words FROM m), c AS (SELECT *, len(list_filter(words, lambda x: x <> '')) AS length, len(list_filter(words, lambda x: x = 'the')) AS a FROM w),
n AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (a > 0) AS da FROM c), h AS (SELECT c.*, CASE WHEN n > 2 * da THEN ln((n - da + 0.5) / (da + 0.5)) ELSE 1e-6 END * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / mean)) AS bm25 FROM c, n WHERE a > 0),
b AS (SELECT * FROM h ORDER BY bm25 DESC, message_id LIMIT 20), s AS (SELECT message_id, row_number() OVER (ORDER BY 0.5 / (1 + bm25) + 0.2 * exp(-({I.AS_OF} - created_at) / 2592000000.0::DOUBLE) DESC, message_id) - 1 AS pos FROM b),
q AS (SELECT embedding::DOUBLE[64] AS e FROM embeddings WHERE vec_id = 0), k AS (SELECT message_id, array_distance(embedding::DOUBLE[64], e) AS distance FROM embeddings JOIN m USING (vec_id), q ORDER BY distance, message_id LIMIT 20),
l AS (SELECT 0 AS list_no, pos, message_id FROM s UNION ALL SELECT 1, row_number() OVER (ORDER BY exp(-distance) DESC, message_id) - 1, message_id FROM k)
SELECT message_id AS item_id, round(sum(1.0::DOUBLE / (61 + pos)), 6) AS score, CAST(row_number() OVER (ORDER BY sum(1.0::DOUBLE / (61 + pos)) DESC, min(list_no * 1000 + pos)) AS INTEGER) AS rank FROM l GROUP BY 1 QUALIFY rank <= 20""")
def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Keywords fused with the vectors nearest to the first message's."""
    from pyspark.sql import Window

    rows = I.messages(spark, d)
    placed = rows.select("message_id", (F.row_number().over(Window.orderBy("conversation_id", "sequence_num")) - 1).alias("vec_id"))
    own = I.table(spark, d, "embeddings").join(placed, "vec_id").select("message_id", "embedding")
    first = I.table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]
    return _r(search.hybrid_search(rows, "the", I.AS_OF, vectors.search(own, list(first), 20), stemmed=False), "score")


_STEMMED = f"""WITH {I.MESSAGES}, w AS (SELECT *, list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM messages),
c AS (SELECT * EXCLUDE (words), len(words) AS length, len(list_filter(words, lambda x: x IN ('thing', 'things', 'thinged', 'thinging', 'thinge', 'thinges'))) AS a, len(list_filter(words, lambda x: x IN ('that', 'thats'))) AS b FROM w),
n AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c), i AS (SELECT *, CASE WHEN n > 2 * da THEN ln((n - da + 0.5) / (da + 0.5)) ELSE 1e-6 END AS ia, CASE WHEN n > 2 * db THEN ln((n - db + 0.5) / (db + 0.5)) ELSE 1e-6 END AS ib FROM n),
h AS (SELECT c.*, ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / mean)) + ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * length / mean)) AS bm25 FROM c, i WHERE a > 0 AND b > 0)"""


@query("search_stemmed", _STEMMED + " SELECT message_id, round(bm25, 6) AS bm25 FROM h")
def search_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """Every match by the stems of 'things that'."""
    return _r(search.bm25(I.messages(spark, d), "things that").select("message_id", "bm25"), "bm25")


@query("search_porter", _STEMMED + f""", b AS (SELECT * FROM h ORDER BY bm25 DESC, message_id LIMIT 20), s AS (SELECT message_id, 0.5 / (1 + bm25) + 0.2 * exp(-({I.AS_OF} - created_at) / 2592000000.0::DOUBLE) AS score FROM b)
SELECT message_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, message_id) - 1 AS INTEGER) AS pos FROM s""")
def search_porter(spark: SparkSession, d: str) -> DataFrame:
    return _r(search.sparse_search(I.messages(spark, d), "things that", I.AS_OF).select("message_id", "score", "pos"), "score")


@query("search_conversation", f"""WITH {I.chats_as('messages')}, c AS (SELECT *, len(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS length, len(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x = 'database')) AS a FROM messages),
n AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (a > 0) AS da FROM c), h AS (SELECT c.*, CASE WHEN n > 2 * da THEN ln((n - da + 0.5) / (da + 0.5)) ELSE 1e-6 END * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / mean)) AS bm25 FROM c, n WHERE a > 0)
SELECT message_id, round(bm25, 6) AS bm25 FROM h WHERE conversation_id = 3 ORDER BY bm25 DESC, message_id LIMIT 10""")
def search_conversation(spark: SparkSession, d: str) -> DataFrame:
    found = search.sparse_search(I.chats(spark, d), "database", I.AS_OF, limit=10, stemmed=False, conversation_id=3)
    return _r(found.select("message_id", "bm25"), "bm25")


# Ranking and assembly


@query("rank_rerank", f"""WITH {I.RANKED}, a AS (SELECT *, score * exp(-({I.AS_OF} - created_at) * ln(2.0) / 2592000000.0::DOUBLE) AS s FROM ranked), b AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY s DESC, pos) - 1 AS p FROM a),
g AS (SELECT *, row_number() OVER (PARTITION BY role, conversation_id ORDER BY p) - 1 AS earlier, count(*) OVER (PARTITION BY role, conversation_id) AS size FROM b), f AS (SELECT *, s * (1 - 0.1 * earlier / max(size) OVER (PARTITION BY role)) AS t FROM g)
SELECT role, item_id, round(t, 6) AS score FROM f""")
def rank_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _r(ranking.rerank(I.ranked(spark, d), I.AS_OF, by=["role"]).select("role", "item_id", "score"), "score")


@query("assemble_packed", f"""WITH {I.chats_as('messages')}, r AS (SELECT *, sum(tokens) OVER (PARTITION BY conversation_id ORDER BY sequence_num DESC ROWS UNBOUNDED PRECEDING) AS used FROM messages) SELECT conversation_id, count(*) AS messages, CAST(max(used) AS BIGINT) AS tokens FROM r WHERE used <= 120 GROUP BY 1""")
def assemble_packed(spark: SparkSession, d: str) -> DataFrame:
    return assembly.recent(I.chats(spark, d), 120).groupBy("conversation_id").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"))


# Summaries


@query("view_timeline", f"WITH {I.chats_as('messages')} SELECT CAST(make_timestamp(created_at * 1000) AS DATE) AS day, count(*) AS messages, count(DISTINCT conversation_id) AS conversations FROM messages GROUP BY 1 ORDER BY 1 DESC LIMIT 7")
def view_timeline(spark: SparkSession, d: str) -> DataFrame:
    return summaries.timeline(I.chats(spark, d))


@query("view_all")
def view_all(spark: SparkSession, d: str) -> DataFrame:
    chats = I.chats(spark, d).where("conversation_id < 10")
    found, edges = graph.build(chats)
    return summaries.views(chats, found, edges, "database", I.AS_OF, preferences=preferences.technologies(chats), stemmed=False)


@query("summary_texts", f"""WITH {I.chats_as('posts')}, n AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence_num) - 1 AS n, floor(count(*) OVER (PARTITION BY conversation_id) * 0.8) AS old FROM posts),
w AS (SELECT *, CAST(CASE WHEN n < old THEN floor(n / 20) ELSE ceil(old / 20) + floor((n - old) / 5) END AS INTEGER) AS window_no FROM n) SELECT conversation_id, window_no, string_agg(role || ': ' || content, chr(10) ORDER BY n) AS text FROM w GROUP BY 1, 2""")
def summary_texts(spark: SparkSession, d: str) -> DataFrame:
    return summaries.window_texts(I.chats(spark, d))


@query("summary_by_model", f"""WITH {I.chats_as('posts')}, n AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence_num) - 1 AS n, floor(count(*) OVER (PARTITION BY conversation_id) * 0.8) AS old FROM posts),
w AS (SELECT *, CAST(CASE WHEN n < old THEN floor(n / 20) ELSE ceil(old / 20) + floor((n - old) / 5) END AS INTEGER) AS window_no FROM n)
SELECT conversation_id, window_no, 'about ' || length(string_agg(role || ': ' || content, chr(10) ORDER BY n)) || ' signs' AS summary FROM w GROUP BY 1, 2""")
def summary_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Summaries by a stand-in for a language model."""
    model = lambda texts: texts.map(lambda t: f"about {len(t)} signs")
    return summaries.window_summaries(I.chats(spark, d), model=model).select("conversation_id", "window_no", "summary")


@query("summary_valid", "SELECT user_id AS conversation_id, max(event_id) AS valid_until FROM events WHERE event_id > 500 GROUP BY 1")
def summary_valid(spark: SparkSession, d: str) -> DataFrame:
    rows = I.table(spark, d, "events").select(F.col("user_id").alias("conversation_id"), F.col("event_id").alias("valid_until"))
    return summaries.valid(rows, 500)


@query("summary_service", f"WITH {I.chats_as('posts')} SELECT conversation_id, count(*) AS messages FROM posts GROUP BY 1")
def summary_service(spark: SparkSession, d: str) -> DataFrame:
    """Stored summaries of some conversations, new ones of the others."""
    chats = I.chats(spark, d)
    stored = summaries.summarise(chats.where("conversation_id % 2 = 0"), I.AS_OF)
    return summaries.Service(stored).summaries(chats, I.AS_OF).select("conversation_id", "messages")


# Queues and updates

_TASKS = I.TASKS + ", t AS (SELECT *, CASE WHEN CAST(key AS BIGINT) % 3 = 0 THEN 'file' WHEN CAST(key AS BIGINT) % 3 = 1 THEN 'mail' ELSE 'web' END AS source_type FROM tasks)"


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("key").cast("long") % 3
    return I.tasks(spark, d).withColumn("source_type", F.when(n == 0, "file").when(n == 1, "mail").otherwise("web"))


@query("queue_process", f"""WITH {_TASKS}, b AS (SELECT task_id FROM t WHERE status = 'pending' AND attempts < 3 ORDER BY coalesce(list_position(['urgent', 'normal'], priority), 3), created_at, task_id LIMIT 50)
SELECT task_id, CASE WHEN task_id NOT IN (SELECT task_id FROM b) THEN status WHEN source_type = 'file' OR source_type = 'mail' AND priority = 'urgent' THEN 'completed' WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, attempts + CASE WHEN task_id IN (SELECT task_id FROM b) THEN 1 ELSE 0 END AS attempts FROM t""")
def queue_process(spark: SparkSession, d: str) -> DataFrame:
    """The next batch by processors of two of the three kinds."""
    work = queues.Processors()
    work.register("file", lambda batch: batch.select("task_id", F.lit(True).alias("ok")))
    work.register("mail", lambda batch: batch.select("task_id", (F.col("priority") == "urgent").alias("ok")))
    return work.process(_tasks(spark, d), I.AS_OF).select("task_id", "status", "attempts")


@query("queue_recent", f"WITH {_TASKS} SELECT task_id, status, updated_at FROM t ORDER BY updated_at DESC, task_id LIMIT 10")
def queue_recent(spark: SparkSession, d: str) -> DataFrame:
    return queues.recent(_tasks(spark, d)).select("task_id", "status", "updated_at")


@query("queue_by_source", f"WITH {_TASKS} SELECT source_type, {', '.join(f'count(*) FILTER (status = {chr(39)}{s}{chr(39)}) AS {s}' for s in queues.STATUSES)}, count(*) AS tasks FROM t GROUP BY 1")
def queue_by_source(spark: SparkSession, d: str) -> DataFrame:
    return queues.by_source(_tasks(spark, d))


@query("queue_retry", f"WITH {_TASKS} SELECT task_id, CASE status WHEN 'failed' THEN 'pending' ELSE status END AS status, CASE status WHEN 'failed' THEN 0 ELSE attempts END AS attempts FROM t")
def queue_retry(spark: SparkSession, d: str) -> DataFrame:
    return queues.retry_failed(_tasks(spark, d)).select("task_id", "status", "attempts")


@query("queue_clear", f"WITH {_TASKS} SELECT task_id FROM t WHERE NOT (status = 'completed' AND updated_at < {I.AS_OF})")
def queue_clear(spark: SparkSession, d: str) -> DataFrame:
    return queues.clear(_tasks(spark, d), older_than=I.AS_OF).select("task_id")


@query("update_counts", f"WITH {PER_CHAT}, e AS (SELECT entity_id, min(created_at) AS f FROM mentions GROUP BY 1) SELECT (SELECT count(*) FROM posts WHERE created_at > {I.START + 360_000_000}) AS new_messages, (SELECT count(*) FROM e WHERE f > {I.START + 360_000_000}) AS new_entities, (SELECT count(*) FROM per WHERE \"at\" > {I.START + 360_000_000}) AS new_edges")
def update_counts(spark: SparkSession, d: str) -> DataFrame:
    chats = I.chats(spark, d)
    found = E.mentions(chats)
    return updates.change_counts(chats, E.merged(found), graph.mention_edges(E.merged(found, ["message_id"])), I.START + 360_000_000)


@query("updates_since", f"""WITH {CHAT_MENTIONS}, e AS (SELECT entity_id, entity_type, min(created_at) AS f FROM mentions WHERE entity_type IN ('decision', 'action') GROUP BY 1, 2),
u AS (SELECT message_id AS id, 'message' AS source, CASE WHEN regexp_matches(content, '(?i)urgent|broken') THEN 'urgent' ELSE 'informational' END AS category, CASE WHEN regexp_matches(content, '(?i)urgent') THEN 10 WHEN regexp_matches(content, '(?i)broken') THEN 9 ELSE 5 END AS priority, created_at FROM posts WHERE created_at > {I.START}
UNION ALL SELECT entity_id, 'entity', entity_type, CASE entity_type WHEN 'action' THEN 8 ELSE 7 END, f FROM e WHERE f > {I.START}) SELECT * FROM u ORDER BY priority DESC, created_at DESC, id LIMIT 2000""")
def updates_since(spark: SparkSession, d: str) -> DataFrame:
    chats = I.chats(spark, d)
    return updates.updates_since(chats, E.extract(chats), I.START, 2000).drop("description")


@query("update_texts", f"""WITH {I.chats_as('posts')}, u AS (SELECT *, CASE WHEN regexp_matches(content, '(?i)urgent') THEN 'urgent' ELSE 'informational' END AS category, CASE WHEN regexp_matches(content, '(?i)urgent') THEN 10 ELSE 5 END AS priority FROM posts WHERE created_at > {I.START} AND contains(content, 'deployment')),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY priority DESC, created_at DESC, message_id) AS n FROM u) SELECT category, string_agg('- ' || content, chr(10) ORDER BY n) AS text FROM r WHERE n <= CASE category WHEN 'urgent' THEN 3 ELSE 5 END GROUP BY 1""")
def update_texts(spark: SparkSession, d: str) -> DataFrame:
    chats = I.chats(spark, d).where("contains(content, 'deployment')")
    return updates.update_text(updates.updates_since(chats, None, I.START, None))


@query("adapter_items", f"""WITH {I.chats_as('posts')} SELECT 'chat' AS source, count(*) AS items, count(DISTINCT conversation_id) AS conversations, min(created_at) AS first, max(created_at) AS last FROM posts WHERE created_at BETWEEN {I.START} AND {I.START + 36_000_000}""")
def adapter_items(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of an adapter's items within a time."""
    items = I.chats(spark, d).withColumn("source", F.lit("chat")).withColumn("source_id", F.col("message_id"))
    return adapters.stats(adapters.fetch(items, I.START, I.START + 36_000_000))
