"""Summaries of conversations at several grains, and multi-view context.

A language model is a function of a series of texts, applied to batches of windows; where
none is given, or it gives nothing, the fallback's first and last words make a summary.
"""

from __future__ import annotations

import math
import re

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .search import sparse_search

WINDOW_SIZE, MAX_TOKENS, TTL = 10, 500, 3_600_000
FILLERS = set("""a about also an and are at be been but by could did do does during for from had has have here how in into is it's just may might now of on or quite rather should so
    such that the then there these this those through to too up very was were when where which who why will with would""".split()) - {"it's"}
KEYWORDS = "agreed concluded critical decided decision discovered found important key main must need realized should will".split()
BASE_TOKENS = {"detailed": 100, "medium": 60, "brief": 30}


def windows(messages: DataFrame, size: int = WINDOW_SIZE) -> DataFrame:
    """messages with ``window_no``: wide windows over the first 80 %, narrow ones over the rest."""
    own = Window.partitionBy("conversation_id")
    n = F.row_number().over(own.orderBy("sequence_num")) - 1
    old = F.floor(F.count("*").over(own) * 0.8)
    wide, narrow = 2 * size, math.ceil(size / 2)
    number = F.when(n < old, F.floor(n / wide)).otherwise(F.ceil(old / wide) + F.floor((n - old) / narrow))
    return messages.withColumn("window_no", number.cast("int")).withColumn("is_recent", n >= old)


Model = Callable[[pd.Series], pd.Series]


def window_texts(messages: DataFrame, size: int = WINDOW_SIZE) -> DataFrame:
    """Each window's messages as one text, 'role: content' a line."""
    line = F.concat("role", F.lit(": "), "content")
    rows = windows(messages, size).groupBy("conversation_id", "window_no").agg(F.array_sort(F.collect_list(F.struct("sequence_num", line.alias("line")))).alias("lines"))
    return rows.select("conversation_id", "window_no", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def window_summaries(messages: DataFrame, size: int = WINDOW_SIZE, model: Model | None = None) -> DataFrame:
    """The model's text for each window, else the fallback's: a message alone as it is, else first and last 100 characters."""
    if model is not None:
        made = window_texts(messages, size).select("conversation_id", "window_no", F.pandas_udf(model, "string")("text").alias("_made"))
        rows = window_summaries(messages, size).join(made, ["conversation_id", "window_no"])
        return rows.withColumn("summary", F.when(F.length(F.trim("_made")) > 0, F.col("_made")).otherwise(F.col("summary"))).drop("_made")
    rows = windows(messages, size).groupBy("conversation_id", "window_no").agg(
        F.count("*").alias("messages"), F.min_by("content", "sequence_num").alias("_first"), F.max_by("content", "sequence_num").alias("_last"), F.min_by("role", "sequence_num").alias("_role"), F.first("is_recent").alias("is_recent"),
    )
    several = F.concat(F.lit("Started with: "), F.substring("_first", 1, 100), F.lit("\nEnded with: "), F.substring("_last", 1, 100))
    text = F.when(F.col("messages") == 1, F.concat("_role", F.lit(": "), "_first")).otherwise(several)
    return rows.select("conversation_id", "window_no", "messages", "is_recent", text.alias("summary"))


def combined(messages: DataFrame, size: int = WINDOW_SIZE, model: Model | None = None) -> DataFrame:
    """One text a conversation: windows under the labels Initially, Earlier, Part n and Recently."""
    own = Window.partitionBy("conversation_id")
    last = F.max("window_no").over(own)
    label = F.when(F.col("window_no") == last, "Recently").when(F.col("window_no") == 0, "Initially").when(F.col("window_no") == last - 1, "Earlier").otherwise(F.concat(F.lit("Part "), (F.col("window_no") + 1).cast("string")))
    rows = window_summaries(messages, size, model).withColumn("_text", F.concat(label, F.lit(":\n"), "summary"))
    return rows.groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window_no", "_text"))), lambda x: x["_text"]), "\n\n").alias("summary"), F.count("*").alias("windows"))


def remove_fillers(text: str) -> str:
    """Lines of at most four words stay; elsewhere fillers go, but for a line's first and last word."""
    out = []
    for line in text.split("\n"):
        w = line.split()
        out.append(line if len(w) <= 4 else " ".join(x for i, x in enumerate(w) if i in (0, len(w) - 1) or x.lower() not in FILLERS))
    return "\n".join(out)


def sentence_importance(sentence: str, index: int, total: int) -> float:
    low = sentence.lower()
    score = 0.3 * (index == 0) + 0.2 * (index == total - 1) + 0.2 * (5 <= len(sentence.split()) <= 20)
    return score + 0.1 * sum(k in low for k in KEYWORDS) + 0.1 * bool(re.search(r"\d", sentence))


def compress(text: str, max_tokens: int = MAX_TOKENS) -> str:
    """To a number of tokens (4 characters each): fillers first, then each section's best sentences, in order of score."""
    if math.ceil(len(text) / 4) <= max_tokens:
        return text
    text = remove_fillers(text)
    if math.ceil(len(text) / 4) <= max_tokens:
        return text
    sections = text.split("\n\n")
    budget = max_tokens // len(sections)
    out = []
    for section in sections:
        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", section) if s.strip()]
        ranked = sorted(range(len(sentences)), key=lambda i: -sentence_importance(sentences[i], i, len(sentences)))
        kept, used = [], 0
        for i in ranked:
            cost = math.ceil(len(sentences[i]) / 4)
            if used + cost <= budget:
                kept.append(sentences[i])
                used += cost
        out.append(" ".join(kept))
    return "\n\n".join(x for x in out if x)


def max_tokens_for(granularity: str, messages: int) -> int:
    return math.floor(BASE_TOKENS[granularity] * math.log(messages + 1))


def coarser(granularity: str) -> str:
    return {"detailed": "medium", "medium": "brief"}.get(granularity, "brief")


def summarise(messages: DataFrame, as_of: int, max_tokens: int = MAX_TOKENS, size: int = WINDOW_SIZE, ttl: int = TTL, model: Model | None = None) -> DataFrame:
    """Progressive summaries of all conversations: text, tokens, compression, valid_until."""

    @F.pandas_udf("string")
    def shorten(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: compress(t, max_tokens), na_action="ignore")

    chars = messages.groupBy("conversation_id").agg(F.sum(F.length("content")).alias("_chars"), F.count("*").alias("messages"))
    rows = combined(messages, size, model).withColumn("summary", shorten("summary")).join(chars, "conversation_id")
    return rows.select("conversation_id", "summary", F.ceil(F.length("summary") / 4).alias("token_count"), "messages", (F.col("_chars") / F.greatest(F.length("summary"), F.lit(1))).alias("compression_ratio"), F.lit(as_of + ttl).alias("valid_until"))


def valid(summaries: DataFrame, as_of: int) -> DataFrame:
    """Stored summaries that still hold; the newest of each scope."""
    live = summaries.where(F.col("valid_until").isNull() | (F.col("valid_until") > as_of))
    return live.withColumn("_n", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("valid_until")))).where("_n = 1").drop("_n")


def view_budgets(total: int, history: float = 0.25, detail: float = 0.5, global_: float = 0.15, preferences: float = 0.1) -> dict[str, int]:
    whole = history + detail + global_ + preferences
    return {k: math.floor(total * v / whole) for k, v in (("history", history), ("detail", detail), ("global", global_), ("preferences", preferences))}


def focus_view(messages: DataFrame, query: str, as_of: int, **options: object) -> DataFrame:
    """The three best hits with their scores (joined by message), and snippets."""
    hits = sparse_search(messages, query, as_of, limit=6, **options).where("pos < 3")
    return hits.select("message_id", "conversation_id", "score", F.substring("content", 1, 200).alias("snippet"), F.avg("score").over(Window.partitionBy()).alias("confidence"))


def term_bonus(content: object, query: str, each: float = 0.2) -> object:
    terms = [t for t in query.lower().split() if t]
    return sum((F.when(F.lower(content).contains(t), each).otherwise(0.0) for t in terms), F.lit(0.0))


def detail_view(messages: DataFrame, edges: DataFrame, entities: DataFrame, query: str, as_of: int, **options: object) -> DataFrame:
    """What lies within two steps of the best hits, nearer things and query terms first: the top ten."""
    starts = focus_view(messages, query, as_of, **options).select(F.concat(F.lit("message:"), "message_id").alias("node"))
    reached = graph.related(edges, starts, max_depth=2).groupBy("node").agg(F.min("depth").alias("depth"))
    reached = F.broadcast(reached)  # 50 nodes of each of three starts at most, so that texts are not shuffled
    near = 1 / (F.col("depth") + 1.0)
    m = reached.join(messages, F.col("node") == F.concat(F.lit("message:"), F.col("message_id"))).select("node", F.lit("message").alias("kind"), F.col("content").alias("text"), near.alias("score"))
    e = reached.join(entities, F.col("node") == F.concat(F.lit("entity:"), F.col("entity_id"))).select("node", F.col("entity_type").alias("kind"), F.col("name").alias("text"), (near * F.col("confidence")).alias("score"))
    rows = m.unionByName(e).withColumn("score", F.col("score") + term_bonus(F.col("text"), query))
    return rows.orderBy(F.desc("score"), "node").limit(10)


def global_view(entities: DataFrame) -> DataFrame:
    """Themes, decisions, actions and questions: the most mentioned of each kind."""
    most = {"topic": 5, "decision": 3, "action": 3, "question": 2, "project": 5, "person": 5}
    place = F.row_number().over(Window.partitionBy("entity_type").orderBy(F.desc("mention_count"), F.desc("last_mentioned"), "entity_id"))
    limit = F.create_map(*(F.lit(x) for kv in most.items() for x in kv))
    return entities.withColumn("place", place).where(F.col("place") <= limit[F.col("entity_type")]).select("entity_type", "place", "name", "mention_count")


def detail_groups(detail: DataFrame) -> DataFrame:
    """The detail view's rows by kind: how many, and their texts, best first."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "node", "text")))
    return detail.groupBy("kind").agg(F.count("*").alias("items"), F.transform(order, lambda x: x["text"]).alias("texts"))


def timeline(messages: DataFrame, days: int = 7) -> DataFrame:
    """Messages and conversations of the last active days."""
    day = F.to_date(F.timestamp_millis("created_at"))
    return messages.groupBy(day.alias("day")).agg(F.count("*").alias("messages"), F.countDistinct("conversation_id").alias("conversations")).orderBy(F.desc("day")).limit(days)


def connections(entities: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """The strongest relationships between entities, with their names."""
    return graph.relationships(edges, entities).limit(limit)


def world_view(messages: DataFrame, entities: DataFrame, edges: DataFrame, preferences: DataFrame | None = None) -> DataFrame:
    """(section, place, text): themes, decisions, actions, questions, sure preferences, timeline and connections."""
    top = global_view(entities).select(F.col("entity_type").alias("section"), "place", F.col("name").alias("text"))
    place = lambda *order: F.row_number().over(Window.orderBy(*order))  # noqa: E731 - over a few rows each
    days = timeline(messages).select(F.lit("timeline").alias("section"), place(F.desc("day")).alias("place"), F.concat(F.col("day").cast("string"), F.lit(": "), F.col("messages").cast("string")).alias("text"))
    links = connections(entities, edges)
    links = links.select(F.lit("connection").alias("section"), place(F.desc("strength"), "source_id", "target_id").alias("place"), F.concat_ws(" ", "source_name", "relationship_type", "target_name").alias("text"))
    out = top.unionByName(days).unionByName(links)
    if preferences is not None:
        sure = preferences.where("confidence > 0.7").orderBy(F.desc("confidence"), "category", "value").limit(5)
        out = out.unionByName(sure.select(F.lit("preference").alias("section"), place(F.desc("confidence"), "category", "value").alias("place"), F.concat_ws(": ", "category", "value").alias("text")))
    return out


def views(messages: DataFrame, entities: DataFrame, edges: DataFrame, query: str, as_of: int, total: int = 2000, preferences: DataFrame | None = None, **options: object) -> DataFrame:
    """All views in one frame: (view, section, place, text), each view within its share of ``total`` tokens."""
    focus = focus_view(messages, query, as_of, **options)
    own = Window.orderBy(F.desc("score"), "message_id")
    rows = focus.select(F.lit("focus").alias("view"), F.lit("message").alias("section"), F.row_number().over(own).alias("place"), F.col("snippet").alias("text"))
    detail = detail_view(messages, edges, entities, query, as_of, **options)
    rows = rows.unionByName(detail.select(F.lit("detail").alias("view"), F.col("kind").alias("section"), F.row_number().over(Window.orderBy(F.desc("score"), "node")).alias("place"), "text"))
    rows = rows.unionByName(world_view(messages, entities, edges, preferences).select(F.lit("global").alias("view"), "section", "place", "text"))
    share = view_budgets(total, 0.0, 0.4, 0.3, 0.3)
    limit = F.create_map(*(F.lit(x) for pair in (("focus", share["preferences"]), ("detail", share["detail"]), ("global", share["global"])) for x in pair))
    used = F.sum(F.ceil(F.length("text") / 4)).over(Window.partitionBy("view").orderBy("place", "section").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_used", used).where(F.col("_used") <= limit[F.col("view")]).drop("_used")


class Service:
    """Summaries by conversation, kept until they are no longer valid."""

    def __init__(self, stored: DataFrame, model: Model | None = None, ttl: int = TTL):
        self.stored, self.model, self.ttl = stored, model, ttl

    def summaries(self, messages: DataFrame, as_of: int, refresh: bool = False) -> DataFrame:
        """Valid stored summaries, and new ones (which are stored) of the other conversations."""
        kept = self.stored.limit(0) if refresh else valid(self.stored, as_of)
        rest = messages.join(kept.select("conversation_id"), "conversation_id", "left_anti")
        made = summarise(rest, as_of, ttl=self.ttl, model=self.model).select(*self.stored.columns)
        self.stored = self.stored.join(made.select("conversation_id"), "conversation_id", "left_anti").unionByName(made)
        return kept.unionByName(made)

    def invalidate(self, ids: DataFrame) -> None:
        """Forget the summaries of conversations, as a new message does."""
        self.stored = self.stored.join(ids.select("conversation_id").distinct(), "conversation_id", "left_anti")
