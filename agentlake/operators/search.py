"""Keyword retrieval by BM25, with recency, context and fusion with vectors.

Statistics come from the live messages.  A query looks at its own terms only: their
frequencies are counted inside each message's word array, so that a search is one
scan with a small aggregate and a top-k.  A stemmed search first looks up the words
of its stems: in a stored ``vocabulary``, or by a scan that keeps only words that begin
as a stem does.  For many queries, ``postings`` can be stored, bucketed by term.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.porter import stem
from ..functions.text import once, words
from .ranking import rrf

K1, B, RECENCY = 1.2, 0.75, 30 * 86_400_000
WEIGHTS = {"sparse": 0.5, "dense": 0.3, "recency": 0.2}


@F.pandas_udf(StringType())
def _stems(words_: pd.Series) -> pd.Series:
    return words_.map(stem, na_action="ignore")


def query_terms(spark_text: str, stemmed: bool) -> list[str]:
    """Distinct terms of a query; any characters are allowed, and all terms must occur."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", spark_text.lower()) if not unicodedata.combining(c))
    found = dict.fromkeys(w for w in re.split(r"[\W_]+", plain) if w)
    return list(dict.fromkeys(stem(w) for w in found)) if stemmed else list(found)


def vocabulary(messages: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(word, term): stems of the distinct words, in Python once a word and not once an occurrence.

    With terms, of the words alone that may have one of these as their stem: stemming
    changes the last two letters of what it keeps at most.
    """
    found = words(F.col("content"))
    if terms is not None:
        heads = sorted({t[: max(1, len(t) - 2)] for t in terms})
        found = F.filter(found, lambda w: F.reduce(F.array(*(F.lit(h) for h in heads)), F.lit(False), lambda hit, h: hit | F.startswith(w, h)))
    return messages.select(F.explode(found).alias("word")).distinct().withColumn("term", _stems("word"))


def postings(messages: DataFrame, stemmed: bool = True) -> DataFrame:
    """(term, message_id, tf, length) for storage, bucketed by term."""
    # The words are a column of their own before they are exploded, else each row would be cut up again.
    cut = messages.select("message_id", F.explode(F.array(F.struct(words(F.col("content")).alias("w")))).alias("c")).select("message_id", F.size("c.w").alias("length"), F.col("c.w").alias("w"))
    rows = cut.select("message_id", "length", F.explode("w").alias("word")).groupBy("word", "message_id", "length").agg(F.count("*").alias("tf"))
    if not stemmed:
        return rows.withColumnRenamed("word", "term")
    return rows.join(vocabulary(messages), "word").groupBy("term", "message_id", "length").agg(F.sum("tf").alias("tf"))


def _count_of(forms: list[str]) -> Column:
    return F.size(F.filter("_words", lambda w: w.isin(forms)))


def bm25(messages: DataFrame, query: str, stemmed: bool = True, known: DataFrame | None = None) -> DataFrame:
    """messages that hold every term, with ``bm25`` (higher is better); no term, no rows.  known: a stored vocabulary."""
    terms = query_terms(query, stemmed)
    if not terms:
        return messages.withColumn("bm25", F.lit(0.0)).where(F.lit(False))
    forms: dict[str, list[str]] = {t: [t] for t in terms}
    if stemmed:
        found = (vocabulary(messages, terms) if known is None else known).where(F.col("term").isin(terms)).collect()  # words of a few stems
        forms = {t: sorted(r["word"] for r in found if r["term"] == t) or [t] for t in terms}
    counted = once(messages, "_words", words(F.col("content")))  # else the filter on counts cuts the text again for each term
    counted = counted.withColumns({"_length": F.size("_words"), **{f"_tf{i}": _count_of(forms[t]) for i, t in enumerate(terms)}})
    n = counted.agg(F.count("*").alias("n"), F.avg("_length").alias("mean"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"d{i}") for i in range(len(terms)))).first()
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(F.lit((n["n"] - n[f"d{i}"] + 0.5) / (n[f"d{i}"] + 0.5))) if n["n"] > 2 * n[f"d{i}"] else F.lit(1e-6)
        tf = F.col(f"_tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_length") / F.lit(n["mean"] or 1.0)))
    every = F.lit(True)
    for i in range(len(terms)):
        every = every & (F.col(f"_tf{i}") > 0)
    return counted.where(every).withColumn("bm25", score).select(*messages.columns, "bm25")


def sparse_score(rank: Column, mode: str = "reference") -> Column:
    """'reference': 1 / (1 + |rank|), which sinks with better matches; 'bm25': x / (1 + x)."""
    return 1 / (1 + F.abs(rank)) if mode == "reference" else F.abs(rank) / (1 + F.abs(rank))


def filtered(messages: DataFrame, conversation_id: object = None, roles: list[str] | None = None, since: int | None = None, until: int | None = None, min_tokens: int | None = None) -> DataFrame:
    """Filters reach the scan; time limits are inclusive."""
    for given, keep in ((conversation_id, F.col("conversation_id") == conversation_id), (since, F.col("created_at") >= since), (until, F.col("created_at") <= until), (min_tokens, F.col("tokens") >= min_tokens)):
        if given is not None:
            messages = messages.where(keep)
    return messages.where(F.col("role").isin(roles)) if roles else messages


def sparse_search(messages: DataFrame, query: str, as_of: int, limit: int = 20, offset: int = 0, weights: dict[str, float] | None = None, mode: str = "reference", stemmed: bool = True, **filters: object) -> DataFrame:
    """The best by BM25, then scored with recency and sorted again; statistics are of all messages."""
    weights = WEIGHTS | (weights or {})
    best = filtered(bm25(messages, query, stemmed), **filters).orderBy(F.desc("bm25"), "message_id").offset(offset).limit(limit)
    recency = F.exp(-(F.lit(as_of) - F.col("created_at")) / F.lit(float(RECENCY)))
    scored = best.withColumn("sparse_score", sparse_score(F.col("bm25"), mode)).withColumn("recency_score", recency)
    scored = scored.withColumn("score", weights["sparse"] * F.col("sparse_score") + weights["recency"] * F.col("recency_score"))
    return scored.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "message_id")) - 1)


def hybrid_search(messages: DataFrame, query: str, as_of: int, vector_hits: DataFrame | None = None, limit: int = 20, **options: object) -> DataFrame:
    """RRF of the keyword list and of vector hits (message_id, score); without vectors the keyword list alone."""
    sparse = sparse_search(messages, query, as_of, limit=limit, **options)
    if vector_hits is None:
        return sparse.select(F.col("message_id").alias("item_id"), "score", (F.col("pos") + 1).alias("rank"))
    dense = vector_hits.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "message_id")) - 1)
    lists = sparse.select(F.lit(0).alias("list_no"), "pos", F.col("message_id").alias("item_id")).unionByName(dense.select(F.lit(1).alias("list_no"), "pos", F.col("message_id").alias("item_id")))
    return rrf(lists).where(F.col("rank") <= limit)


def message_context(messages: DataFrame, targets: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """Messages around each target in its conversation, with the target's id."""
    around = targets.select(F.col("message_id").alias("target_id")).join(messages.select(F.col("message_id").alias("target_id"), "conversation_id", F.col("sequence_num").alias("_at")), "target_id")
    near = messages.join(around, "conversation_id").where(F.col("sequence_num").between(F.col("_at") - before, F.col("_at") + after))
    return near.drop("_at")


def find_similar(messages: DataFrame, message_id: str, as_of: int, limit: int = 10, **options: object) -> DataFrame:
    """Search by the first 500 characters of a message, which is left out after the limit."""
    text = messages.where(F.col("message_id") == message_id).select(F.substring("content", 1, 500)).first()
    found = sparse_search(messages, text[0] if text else "", as_of, limit=limit, **options)
    return found.where(F.col("message_id") != message_id)


def suggestions(prefix: str) -> list[str]:
    """None are ever made, as in the reference."""
    return []
