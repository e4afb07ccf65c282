"""Token estimates by model family, and their cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import utf16_length

FAMILIES = ("claude", "gpt", "gemini", "llama", "unknown")


def model_family(model: Column, explicit: Column | None = None) -> Column:
    """The family that a model's name tells, unless one is given."""
    name = F.lower(model)
    told = (
        F.when(name.contains("claude"), "claude")
        .when(name.contains("gpt") | name.contains("openai"), "gpt")
        .when(name.contains("gemini"), "gemini")
        .when(name.contains("llama"), "llama")
        .otherwise("unknown")
    )
    return told if explicit is None else F.coalesce(explicit, told)


def token_count(text: Column, family: Column) -> Column:
    """Counter's estimate: 4 characters a token for gpt, gemini and llama, else 3.5."""
    per = F.when(family.isin("gpt", "gemini", "llama"), F.lit(4.0)).otherwise(F.lit(3.5))
    return F.ceil(utf16_length(text) / per)


def estimate_tokens(text: Column, family: Column | None = None) -> Column:
    """Quick estimate: 3.5 characters a token for claude, else 4."""
    claude = F.lit(False) if family is None else F.coalesce(family == "claude", F.lit(False))
    return F.ceil(utf16_length(text) / F.when(claude, F.lit(3.5)).otherwise(F.lit(4.0)))


def format_tokens(count: Column) -> Column:
    return (
        F.when(count < 1000, count.cast("string"))
        .when(count < 1_000_000, F.format_string("%.1fK", count / 1000.0))
        .otherwise(F.format_string("%.1fM", count / 1_000_000.0))
    )


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def count_with_cache(messages: DataFrame, cache: DataFrame) -> DataFrame:
    """messages (content, model_family) with ``tokens`` and ``cached``; cache has (content_hash, family, count)."""
    family = F.coalesce(F.col("model_family"), F.lit("unknown"))
    keyed = messages.withColumn("_hash", content_hash(F.col("content"))).withColumn("_family", family)
    known = cache.select(F.col("content_hash").alias("_hash"), F.col("family").alias("_family"), F.col("count").alias("_count"))
    out = keyed.join(known, ["_hash", "_family"], "left")
    return out.withColumn("tokens", F.coalesce("_count", token_count(F.col("content"), F.col("_family")))).withColumn("cached", F.col("_count").isNotNull()).drop("_hash", "_family", "_count")


def new_cache_rows(messages: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows to add to the cache, keyed by hash and family."""
    family = F.coalesce(F.col("model_family"), F.lit("unknown"))
    fresh = messages.select(content_hash(F.col("content")).alias("content_hash"), family.alias("family"), token_count(F.col("content"), family).alias("count")).dropDuplicates(["content_hash", "family"])
    return fresh.join(cache.select("content_hash", "family"), ["content_hash", "family"], "left_anti")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("family").agg(F.count("*").alias("entries"))


def clear_cache(cache: DataFrame, family: str | None = None) -> DataFrame:
    return cache.where(F.lit(False)) if family is None else cache.where(F.col("family") != family)
