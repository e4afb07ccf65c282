"""What is new since a time: messages by urgency, entities, counts, texts and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once

URGENT: list[tuple[str, int]] = [
    ("urgent|asap|immediately|critical|emergency", 10), ("deadline|due today|due tomorrow|due soon", 9), ("breaking|broken|failing|error|bug|crash", 9), ("security|vulnerability|exploit", 10),
]
BLOCKING: list[tuple[str, int]] = [("blocked|blocker|stuck|waiting|need help", 8), ("can't|cannot|unable to|won't work", 7), ("dependency|depends on|prerequisite", 7)]


def holds_any(low: Column, words: str) -> Column:
    """Whether a text in lower case holds one of the words (given between bars): plain searches, no regular expression."""
    return reduce(lambda a, b: a | b, (low.contains(w) for w in words.split("|")))


def categorised(low: Column) -> Column:
    """struct(category, priority) of a text in lower case by the first words that are found: urgent, blocking, else informational."""
    out = None
    for name, listed in (("urgent", URGENT), ("blocking", BLOCKING)):
        for words, priority in listed:
            value = F.struct(F.lit(name).alias("category"), F.lit(priority).alias("priority"))
            out = F.when(holds_any(low, words), value) if out is None else out.when(holds_any(low, words), value)
    return out.otherwise(F.struct(F.lit("informational").alias("category"), F.lit(5).alias("priority")))


def default_category(content: Column) -> Column:
    return F.struct(F.lit("informational").alias("category"), F.when(content.contains("?"), 6).otherwise(5).alias("priority"))


def short_text(content: Column) -> Column:
    """The first sentence if it is short enough, else 100 characters."""
    first = F.regexp_extract(content, r"^[^.!?]+[.!?]", 0)
    return F.when((F.length(first) > 0) & (F.length(first) <= 100), first).when(F.length(content) > 100, F.concat(F.substring(content, 1, 100), F.lit("..."))).otherwise(content)


def updates_since(messages: DataFrame, entities: DataFrame | None, since: int, limit: int | None = 20, categorise: bool = True) -> DataFrame:
    """New messages and new decisions and actions, most urgent first."""
    fresh = messages.where(F.col("created_at") > since).select("message_id", "content", "created_at")
    if categorise:
        fresh = once(once(fresh, "_low", F.lower("content")), "_kind", categorised(F.col("_low")))
    else:
        fresh = once(fresh, "_kind", default_category(F.col("content")))
    rows = fresh.select(F.col("message_id").alias("id"), F.lit("message").alias("source"), "_kind.category", "_kind.priority", short_text(F.col("content")).alias("description"), "created_at")
    if entities is not None:
        fresh = entities.where((F.col("first_mentioned") > since) & F.col("entity_type").isin("decision", "action"))
        level = F.when(F.col("entity_type") == "action", 8).otherwise(7)
        rows = rows.unionByName(fresh.select(F.col("entity_id").alias("id"), F.lit("entity").alias("source"), F.col("entity_type").alias("category"), level.alias("priority"), F.col("name").alias("description"), F.col("first_mentioned").alias("created_at")))
    rows = rows.orderBy(F.desc("priority"), F.desc("created_at"), "id")
    return rows if limit is None else rows.limit(limit)


def update_text(updates: DataFrame) -> DataFrame:
    """Three urgent, three blocking and five other descriptions, under their headings."""
    most = F.when(F.col("category").isin("urgent", "blocking"), 3).otherwise(5)
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("priority"), F.desc("created_at"), "id"))
    rows = updates.withColumn("_n", place).where(F.col("_n") <= most)
    return rows.groupBy("category").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("_n", "description"))), lambda x: F.concat(F.lit("- "), x["description"]))).alias("text"))


def diff(before: DataFrame, after: DataFrame, names: list[str]) -> DataFrame:
    """Differences of one-row snapshots."""
    old = before.select(*(F.col(n).alias(f"_{n}") for n in names))
    return after.crossJoin(old).select(*((F.col(n) - F.col(f"_{n}")).alias(n) for n in names))


def last_update(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_id").agg(F.max("created_at").alias("last_update"))


def change_counts(messages: DataFrame, entities: DataFrame, edges: DataFrame, since: int) -> DataFrame:
    """New messages, entities and edges since a time, in one row."""
    one = messages.agg(F.count_if(F.col("created_at") > since).alias("new_messages"))
    two = entities.agg(F.count_if(F.col("first_mentioned") > since).alias("new_entities"))
    return one.crossJoin(two).crossJoin(edges.agg(F.count_if(F.col("created_at") > since).alias("new_edges")))
