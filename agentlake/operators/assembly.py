"""Packing messages into a token budget.

Packing is greedy in an order and stops at the first message that does not fit: since
tokens are not negative, that is a running sum within the budget.  All conversations
are packed at once; ``conversation_id`` partitions the windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import iso_time
from .ranking import rerank
from .search import sparse_search

STRATEGIES = ("recent", "relevant", "hybrid", "sliding-window", "full")


def pack(messages: DataFrame, budget: int | Column, *order: Column | str, include_system: bool = True) -> DataFrame:
    """Messages of each conversation, in the order, until one does not fit."""
    if not include_system:
        messages = messages.where("role != 'system'")
    running = F.sum("tokens").over(Window.partitionBy("conversation_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("_running", running).where(F.col("_running") <= budget).drop("_running")


def recent(messages: DataFrame, budget: int, include_system: bool = True) -> DataFrame:
    """The newest that fit; also the sliding window."""
    return pack(messages, budget, F.desc("sequence_num"), include_system=include_system)


def full(messages: DataFrame, include_system: bool | None = None) -> DataFrame:
    """Everything, whatever the budget; system messages only if asked for."""
    return messages if include_system else messages.where("role != 'system'")


def relevant(messages: DataFrame, query: str, budget: int, as_of: int, conversation_id: object, candidates: int = 100, min_score: float = 0.1, include_system: bool = True, **options: object) -> DataFrame:
    if not query:
        raise ValueError("relevant assembly needs a query")
    found = sparse_search(messages, query, as_of, limit=candidates, conversation_id=conversation_id, **options).where(F.col("score") >= min_score)
    return pack(rerank(found, as_of), budget, "rank", include_system=include_system).select(*messages.columns)


def hybrid(messages: DataFrame, budget: int, as_of: int, conversation_id: object, query: str | None = None, preserve_recent: int = 5, share: float = 0.6, include_system: bool = True, **options: object) -> DataFrame:
    """The last messages within a share of the budget, then relevant ones in the rest."""
    own = messages.where(F.col("conversation_id") == conversation_id)
    last = own.withColumn("_n", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("sequence_num")))).where(F.col("_n") <= preserve_recent).drop("_n")
    first = pack(last, int(budget * share), F.desc("sequence_num"), include_system=include_system)
    if not query:
        return first
    found = rerank(sparse_search(messages, query, as_of, limit=50, conversation_id=conversation_id, **options), as_of)
    rest = pack(found.join(first.select("message_id"), "message_id", "left_anti"), budget - int(budget * share), "rank", include_system=include_system)
    return first.unionByName(rest.select(*messages.columns))


def assemble(messages: DataFrame, strategy: str, budget: int, as_of: int, conversation_id: object, query: str | None = None, include_system: bool | None = None, **options: object) -> DataFrame:
    """One conversation's context in chronological order."""
    own = messages.where(F.col("conversation_id") == conversation_id)
    keep = include_system is not False
    if strategy in ("recent", "sliding-window"):
        out = recent(own, budget, keep)
    elif strategy == "relevant":
        out = relevant(messages, query or "", budget, as_of, conversation_id, include_system=keep, **options)
    elif strategy == "hybrid":
        out = hybrid(messages, budget, as_of, conversation_id, query, include_system=keep, **options)
    elif strategy == "full":
        out = full(own, include_system)
    else:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    return out.orderBy("sequence_num")


def metadata(included: DataFrame, all_messages: DataFrame, budget: int) -> DataFrame:
    """Per conversation: tokens, share of the budget, what is left, counts, whether anything was cut."""
    mine = included.groupBy("conversation_id").agg(F.sum("tokens").alias("total_tokens"), F.count("*").alias("included"))
    whole = all_messages.groupBy("conversation_id").agg(F.count("*").alias("messages"))
    out = whole.join(mine, "conversation_id", "left").fillna({"total_tokens": 0, "included": 0})
    return out.select("conversation_id", "total_tokens", (F.col("total_tokens") / F.lit(float(budget))).alias("used"), (F.lit(budget) - F.col("total_tokens")).alias("remaining"), "included", "messages", (F.col("included") < F.col("messages")).alias("truncated"))


def estimate_message_count(messages: DataFrame, budget: int) -> DataFrame:
    return recent(messages, budget).groupBy("conversation_id").agg(F.count("*").alias("messages"))


def summary(messages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Counts, time of the last message and its last three snippets, per conversation."""
    back = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("sequence_num")))
    rows = messages.withColumn("_back", back)
    snippet = F.when(F.col("_back") <= 3, F.struct(-F.col("_back"), F.concat(F.col("role"), F.lit(": "), F.substring("content", 1, 100)).alias("t")))
    out = rows.groupBy("conversation_id").agg(
        F.count("*").alias("messages"), F.sum("tokens").alias("tokens"), iso_time(F.max("created_at")).alias("last_active"),
        F.array_join(F.transform(F.array_sort(F.collect_list(snippet)), lambda x: x["t"]), "\n").alias("recent"),
    )
    return out if titles is None else out.join(titles, "conversation_id", "left")
