"""The driver's tables in the shapes that the operators take, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import token_count

#: The time that stands for now, and the first message's time.
START, AS_OF = 1_700_000_000_000, 1_701_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: an hour between conversations, a minute between turns."""
    rows = table(spark, sf_dir, "conversations")
    at = F.lit(START) + F.col("conv_id") * 3_600_000 + F.col("turn") * 60_000
    return rows.select(F.format_string("m%d-%d", "conv_id", "turn").alias("message_id"), F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"), token_count(F.col("text"), F.lit("gpt")).alias("tokens"), F.col("turn").cast("int").alias("sequence_num"), at.alias("created_at"))


MESSAGES = f"""messages AS (
  SELECT format('m{{}}-{{}}', conv_id, turn) AS message_id, conv_id AS conversation_id, role, text AS content, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens,
    CAST(turn AS INTEGER) AS sequence_num, {START} + conv_id * 3600000 + turn * 60000 AS created_at FROM conversations)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as messages of their source, a second apart."""
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.format_string("d%d", "doc_id").alias("message_id"), F.col("source").alias("conversation_id"), F.when(F.col("doc_id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("text").alias("content"), token_count(F.col("text"), F.lit("gpt")).alias("tokens"), F.col("doc_id").cast("int").alias("sequence_num"), (F.lit(START) + F.col("doc_id") * 1000).alias("created_at"))


POSTS = f"""posts AS (
  SELECT format('d{{}}', doc_id) AS message_id, source AS conversation_id, CASE WHEN doc_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, text AS content,
    CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(doc_id AS INTEGER) AS sequence_num, {START} + doc_id * 1000 AS created_at FROM documents)"""


#: What the orders' chats say, by turns.
LINES = [
    "Let's use PostgreSQL for project Atlas and the database.", "Which database should we choose for testing?", "As I mentioned, @bob will fix the React deployment.",
    "The meeting with Mike Jones was about authentication. TODO: write the tests", "My meeting with Michael Jones went well, React and TypeScript it is", "We must ship release Apollo with Docker and Docker Compose.",
    "Can you explain the GraphQL API?", "Sure, React with TypeScript and React hooks.", "urgent: the deployment is broken, need help", "decision: keep Redis and Python for sprint Orion", "thanks",
    "regarding the message above, we decided to drop the REST API of project Atlas",
]


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as messages of 200 conversations, 25 seconds apart, that say LINES in turn; users and assistants alternate."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("conversation_id"), F.element_at(F.array(*(F.lit(x) for x in LINES)), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % len(LINES) + 1).cast("int")).alias("content"))
    rows = rows.withColumn("sequence_num", (F.row_number().over(Window.partitionBy("conversation_id").orderBy("o_orderkey")) - 1).cast("int"))
    return rows.select(F.format_string("c%d", "o_orderkey").alias("message_id"), "conversation_id", F.when(F.col("sequence_num") % 2 == 0, "user").otherwise("assistant").alias("role"), "content", token_count(F.col("content"), F.lit("gpt")).alias("tokens"), "sequence_num", (F.lit(START) + F.col("conversation_id") * 3_600_000 + F.col("sequence_num").cast("long") * 25_000).alias("created_at"))


_LINE_LIST = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in LINES) + "]"


def chats_as(name: str) -> str:
    """SQL of the chats under a name."""
    return f"""{name}_lines AS (SELECT o_orderkey, o_custkey % 200 AS conversation_id, ({_LINE_LIST})[(o_orderkey * 7 + o_custkey) % {len(LINES)} + 1] AS content, CAST(row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) - 1 AS INTEGER) AS sequence_num FROM orders),
{name} AS (SELECT 'c' || o_orderkey AS message_id, conversation_id, CASE WHEN sequence_num % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, content, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens, sequence_num, {START} + conversation_id * 3600000 + sequence_num * 25000 AS created_at FROM {name}_lines)"""


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of each source's documents: by length and by number, with weights."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents")
    out = None
    for number, (order, weight, score) in enumerate(((F.desc("n_chars"), 2.0, F.col("n_chars").cast("double")), (F.col("doc_id"), 1.0, 1 / (F.col("doc_id") + 1.0)))):
        pos = F.row_number().over(Window.partitionBy("source").orderBy(order, "doc_id")) - 1
        rows = docs.select(F.col("source").alias("query_id"), F.lit(number).alias("list_no"), pos.alias("pos"), F.col("doc_id").alias("item_id"), F.lit(weight).alias("weight"), score.alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


LISTS = """lists AS (
  SELECT source AS query_id, 0 AS list_no, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS pos, doc_id AS item_id, 2.0::DOUBLE AS weight, n_chars::DOUBLE AS score FROM documents
  UNION ALL SELECT source, 1, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1, doc_id, 1.0::DOUBLE, 1 / (doc_id + 1.0::DOUBLE) FROM documents)"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of each role as one ranked list over conversations, longest first."""
    from pyspark.sql import Window

    rows = messages(spark, sf_dir)
    pos = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("tokens"), "message_id")) - 1
    return rows.select("role", F.col("message_id").alias("item_id"), "conversation_id", "created_at", pos.alias("pos"), (1 / (pos + 1.0)).alias("score"))


RANKED = MESSAGES + """, ranked AS (
  SELECT role, message_id AS item_id, conversation_id, created_at, pos, 1 / (pos + 1.0::DOUBLE) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY tokens DESC, message_id) - 1 AS pos FROM messages))"""


def compactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of type view as compactions of conversations."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("conversation_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"))


COMPACTIONS = "compactions AS (SELECT event_id, user_id AS conversation_id, (epoch_us(ts) // 1000) AS created_at FROM events)"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tasks of a queue."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("task_id"), F.col("user_id").cast("string").alias("key"), F.element_at(F.array(F.lit("urgent"), F.lit("normal"), F.lit("low")), (F.col("event_id") % 3 + 1).cast("int")).alias("priority"),
        F.element_at(F.array(*(F.lit(x) for x in ("pending", "processing", "completed", "failed"))), (F.col("event_id") % 4 + 1).cast("int")).alias("status"), (F.col("event_id") % 5).cast("int").alias("attempts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"), F.unix_millis(F.col("ts").cast("timestamp")).alias("updated_at"),
    )


TASKS = """tasks AS (SELECT CAST(event_id AS VARCHAR) AS task_id, CAST(user_id AS VARCHAR) AS key, (['urgent','normal','low'])[event_id % 3 + 1] AS priority,
  (['pending','processing','completed','failed'])[event_id % 4 + 1] AS status, CAST(event_id % 5 AS INTEGER) AS attempts, (epoch_us(ts) // 1000) AS created_at, (epoch_us(ts) // 1000) AS updated_at FROM events)"""
