"""Conversation store: appends, look-ups, updates and statistics as frames.

Counters of a conversation are derived from its messages, never kept by hand.
Mutations return the new frame; writing it is the caller's choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("created_at", "updated_at")


def add_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """messages with the rows of new (conversation_id, position, role, content, tokens, created_at) appended.

    Sequence numbers go on from each conversation's last, from 0.
    """
    last = messages.groupBy("conversation_id").agg(F.max("sequence_num").alias("_last"))
    turn = F.row_number().over(Window.partitionBy("conversation_id").orderBy("position"))
    placed = new.join(last, "conversation_id", "left").withColumn("sequence_num", (F.coalesce("_last", F.lit(-1)) + turn).cast("int"))
    key = F.concat_ws("-", F.lit("msg"), F.col("conversation_id"), F.col("sequence_num"))
    return messages.unionByName(placed.withColumn("message_id", key).select(*messages.columns))


def with_counters(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    counted = messages.groupBy("conversation_id").agg(F.count("*").alias("message_count"), F.sum("tokens").alias("total_tokens"), F.max("created_at").alias("last_message_at"))
    return conversations.join(counted, "conversation_id", "left").fillna({"message_count": 0, "total_tokens": 0})


def conversation(conversations: DataFrame, key: str, by: str = "conversation_id") -> DataFrame:
    return conversations.where(F.col(by) == key).limit(1)


def list_conversations(conversations: DataFrame, limit: int = 100, offset: int = 0, order_by: str = "updated_at", ascending: bool = False) -> DataFrame:
    if order_by not in ORDER:
        raise ValueError(f"order_by must be one of {ORDER}")
    first = F.col(order_by).asc() if ascending else F.col(order_by).desc()
    return conversations.orderBy(first, "conversation_id").offset(offset).limit(limit)


def conversation_messages(messages: DataFrame, conversation_id: object, limit: int | None = None, offset: int = 0) -> DataFrame:
    """In order; an offset counts only with a limit."""
    own = messages.where(F.col("conversation_id") == conversation_id).orderBy("sequence_num")
    return own if limit is None else own.offset(offset).limit(limit)


def overlay(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with the non-null columns of changes written over those of the same key."""
    names = [c for c in rows.columns if c != key and c in changes.columns]
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in names))
    joined = rows.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns))


def missing_keys(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changes to rows that do not exist (an error for an update)."""
    return changes.join(rows.select(key), key, "left_anti")


def delete_messages(messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages without those ids, what each conversation lost)."""
    gone = messages.join(ids.select("message_id").distinct(), "message_id", "left_semi")
    lost = gone.groupBy("conversation_id").agg(F.count("*").alias("removed"), F.sum("tokens").alias("removed_tokens"))
    return messages.join(ids.select("message_id").distinct(), "message_id", "left_anti"), lost


def compaction_history(events: DataFrame, conversation_id: object) -> DataFrame:
    return events.where(F.col("conversation_id") == conversation_id).orderBy(F.desc("created_at"), F.desc("event_id"))


def mark_compacted(conversations: DataFrame, events: DataFrame) -> DataFrame:
    done = events.select("conversation_id").distinct().withColumn("_done", F.lit(True))
    return conversations.join(done, "conversation_id", "left").withColumn("compacted", F.coalesce("_done", "compacted", F.lit(False))).drop("_done")


def conversation_stats(messages: DataFrame, compactions: DataFrame) -> DataFrame:
    """Per conversation; each side is aggregated before the join, so that they do not multiply."""
    m = messages.groupBy("conversation_id").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"), F.max("created_at").alias("last_message_at"))
    c = compactions.groupBy("conversation_id").agg(F.countDistinct("event_id").alias("compactions"), F.max("created_at").alias("last_compaction_at"))
    return m.join(c, "conversation_id", "left").fillna({"compactions": 0})


def store_stats(messages: DataFrame, compactions: DataFrame) -> DataFrame:
    one = messages.agg(F.countDistinct("conversation_id").alias("conversations"), F.count("*").alias("messages"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return one.crossJoin(compactions.agg(F.count("*").alias("compactions")))


def recent_messages(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    titles = conversations.select("conversation_id", "session_key", "title")
    return messages.join(titles, "conversation_id").orderBy(F.desc("created_at"), "message_id")


def last_write(settings: DataFrame) -> DataFrame:
    """Upsert of (key, value, updated_at): the latest value of each key."""
    return settings.groupBy("key").agg(F.max_by("value", "updated_at").alias("value"), F.max("updated_at").alias("updated_at"))


def newest(rows: DataFrame, status: str | None = None, domain: str | None = None, limit: int | None = None, key: str = "id") -> DataFrame:
    """Services, goals and findings: newest first, by status and domain."""
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if domain is not None:
        rows = rows.where(F.col("domain") == domain)
    rows = rows.orderBy(F.desc("created_at"), key)
    return rows if limit is None else rows.limit(limit)


def stamped(status: Column, at: Column) -> dict[str, Column]:
    """The times that a finding's new status sets."""
    return {f"{s}_at": F.when(status == s, at) for s in ("presented", "acted", "dismissed")}


def last_researched(log: DataFrame) -> DataFrame:
    return log.groupBy("target").agg(F.max("created_at").alias("last_researched"))


def zero_as_null(value: Column) -> Column:
    """The reference's habit of storing 0 as absent; an option of the callers."""
    return F.when(value != 0, value)


def export_jsonl(messages: DataFrame, path: str) -> None:
    """role, content, timestamp and tokens, a line a message."""
    lines = messages.orderBy("conversation_id", "sequence_num").select(F.to_json(F.struct("role", "content", F.col("created_at").alias("timestamp"), "tokens")).alias("value"))
    lines.write.mode("overwrite").text(path)


def aggregate_stats(messages: DataFrame, by: str = "user_id") -> DataFrame:
    """Sums by user over all users."""
    return messages.groupBy(by).agg(F.countDistinct("conversation_id").alias("conversations"), F.count("*").alias("messages"), F.sum("tokens").alias("tokens"))


def health(memory_ratio: float, open_files_ratio: float, hit_rate: float, evictions: int, requests: int) -> tuple[int, str]:
    """(score, status) of a manager from its resource figures."""
    score = 100
    score -= 40 if memory_ratio > 0.9 else 20 if memory_ratio > 0.75 else 0
    score -= 30 if open_files_ratio > 0.9 else 15 if open_files_ratio > 0.75 else 0
    score -= 10 if requests > 100 and hit_rate < 0.5 else 0
    score -= 10 if requests and evictions > requests / 2 else 0
    return score, "healthy" if score >= 80 else "degraded" if score >= 50 else "critical"
