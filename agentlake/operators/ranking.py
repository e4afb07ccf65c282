"""Rank fusion, decay, diversity and evaluation of ranked lists.

A ranked list has rows (item_id, pos from 0, score, ...); several lists are one
frame with a column that tells them apart.  Everything is windows and
aggregations, so that many queries are ranked at once by ``by``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000
HALF_LIFE, DIVERSITY, RRF_K = 30 * DAY, 0.1, 60


def _ranked(rows: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order)))


def rrf(lists: DataFrame, k: int = RRF_K, by: list[str] | None = None, payload: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion of (list_no, pos, item_id): score, rank from 1.

    An item that occurs twice in a list counts twice; ties keep the order of first
    appearance; payload columns are those of the first appearance.
    """
    by = by or []
    first = F.struct("list_no", "pos")
    fused = lists.groupBy(*by, "item_id").agg(F.sum(1 / (k + F.col("pos") + 1)).alias("score"), F.min(first).alias("_first"), *(F.min_by(c, first).alias(c) for c in payload or []))
    return _ranked(fused, by, F.desc("score"), "_first").drop("_first")


def weighted_rrf(lists: DataFrame, k: int = RRF_K, min_score: float = 0.0, limit: int | None = 20, by: list[str] | None = None) -> DataFrame:
    """RRF of (source, weight, list_no, pos, item_id); weights are normalised, a weight of 0 counts as 1; sources are joined by '+'."""
    by = by or []
    weight = F.when(F.coalesce("weight", F.lit(0)) == 0, F.lit(1.0)).otherwise(F.col("weight"))
    sets = lists.select(*by, "list_no", weight.alias("_w")).distinct().groupBy(*by).agg(F.sum("_w").alias("_total"))
    rows = lists.withColumn("_w", weight)
    rows = rows.join(F.broadcast(sets), by) if by else rows.crossJoin(F.broadcast(sets))
    fused = rows.groupBy(*by, "item_id").agg(
        F.sum(F.col("_w") / F.col("_total") / (k + F.col("pos") + 1)).alias("score"),
        F.min(F.struct("list_no", "pos")).alias("_first"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("list_no", "source"))), lambda x: x["source"]), "+").alias("sources"),
    )
    out = _ranked(fused.where(F.col("score") >= min_score), by, F.desc("score"), "_first").drop("_first")
    return out if limit is None else out.where(F.col("rank") <= limit)


def weighted_average(lists: DataFrame, by: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Mean of min-max normalised scores over the lists that hold the item, by weight."""
    by = by or []
    own = Window.partitionBy(*by, "list_no")
    low, high = F.min("score").over(own), F.max("score").over(own)
    scaled = lists.withColumn("_s", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.col("score")))
    fused = scaled.groupBy(*by, "item_id").agg((F.sum(F.col("weight") * F.col("_s")) / F.sum("weight")).alias("score"), F.min(F.struct("list_no", "pos")).alias("_first"))
    out = _ranked(fused, by, F.desc("score"), "_first").drop("_first")
    return out if limit is None else out.where(F.col("rank") <= limit)


def temporal_decay(rows: DataFrame, as_of: int, half_life: float = HALF_LIFE, by: list[str] | None = None) -> DataFrame:
    """score halved for every half_life milliseconds of age; a half_life of 0 gives NaN."""
    rate = F.lit(float("nan")) if half_life == 0 else F.exp(-(F.lit(as_of) - F.col("created_at")) * F.log(F.lit(2.0)) / half_life)
    return _ranked(rows.withColumn("score", F.col("score") * rate), by or [], F.desc("score"), "pos")


def diversify(rows: DataFrame, weight: float = DIVERSITY, by: list[str] | None = None, order: str = "pos") -> DataFrame:
    """Scores lowered by how many of the conversation came before, against the largest conversation."""
    by = by or []
    group = Window.partitionBy(*by, "conversation_id")
    earlier = F.row_number().over(group.orderBy(order)) - 1
    sized = rows.withColumn("_earlier", earlier).withColumn("_size", F.count("*").over(group))
    largest = F.max("_size").over(Window.partitionBy(*(by or [F.lit(1)])))
    out = sized.withColumn("original_rank", F.col(order) + 1).withColumn("score", F.col("score") * (1 - weight * F.col("_earlier") / largest))
    return _ranked(out.drop("_size").withColumnRenamed("_earlier", "conversation_group"), by, F.desc("score"), order)


def rerank(rows: DataFrame, as_of: int, half_life: float = HALF_LIFE, weight: float = DIVERSITY, by: list[str] | None = None) -> DataFrame:
    """Decay unless half_life is 0, then diversity unless weight is 0."""
    out = rows
    if half_life:
        out = temporal_decay(out, as_of, half_life, by).withColumn("pos", F.col("rank") - 1)
    if weight:
        out = diversify(out, weight, by).withColumn("pos", F.col("rank") - 1)
    return out


def top_per_conversation(rows: DataFrame, n: int = 3, by: list[str] | None = None) -> DataFrame:
    """The first n of each conversation in the list's order, ranked anew."""
    by = by or []
    first = F.row_number().over(Window.partitionBy(*by, "conversation_id").orderBy("pos"))
    return _ranked(rows.withColumn("_n", first).where(F.col("_n") <= n).drop("_n"), by, "pos")


def mrr(results: DataFrame, relevant: DataFrame, by: list[str]) -> DataFrame:
    """1 / place of the first relevant item of each query, 0 without one."""
    hit = results.join(relevant.select(*by, "item_id").distinct(), [*by, "item_id"], "left_semi").groupBy(*by).agg(F.min("pos").alias("_pos"))
    return results.select(*by).distinct().join(hit, by, "left").select(*by, F.coalesce(1 / (F.col("_pos") + 1), F.lit(0.0)).alias("mrr"))


def ndcg(results: DataFrame, relevance: DataFrame, by: list[str], k: int | None = None) -> DataFrame:
    """Gain against that of the ideal order of all judgements, cut to the length of the results."""
    if k is not None:
        results = results.where(F.col("pos") < k)
    length = results.groupBy(*by).agg(F.count("*").alias("_n"))
    gain = results.join(relevance.select(*by, "item_id", "relevance"), [*by, "item_id"]).groupBy(*by).agg(F.sum(F.col("relevance") / F.log2(F.col("pos") + 2.0)).alias("_gain"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("relevance"), "item_id")) - 1
    ideal = relevance.withColumn("_p", place).join(length, by).where("_p < _n").groupBy(*by).agg(F.sum(F.col("relevance") / F.log2(F.col("_p") + 2.0)).alias("_ideal"))
    out = length.join(gain, by, "left").join(ideal, by, "left")
    return out.select(*by, F.when(F.coalesce("_ideal", F.lit(0.0)) > 0, F.coalesce("_gain", F.lit(0.0)) / F.col("_ideal")).otherwise(F.lit(0.0)).alias("ndcg"))


def explain(score: Column, sparse: Column, dense: Column, recency: Column) -> Column:
    """'Score: … | Sparse: …' with four decimals, rounded as C's printf does by the exact value (the JVM goes by the shortest decimal form); absent parts are left out."""

    @F.pandas_udf("string")
    def four_decimals(values: pd.Series) -> pd.Series:
        return pd.Series([f"{x:.4f}" for x in values], dtype=object)

    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), four_decimals(c.cast("double"))))
    return F.concat_ws(" | ", part("Score", score), part("Sparse", sparse), part("Dense", dense), part("Recency", recency))


def best_across_queries(rows: DataFrame, as_of: int) -> DataFrame:
    """Each query's list reranked, then fused."""
    ranked = rerank(rows, as_of, by=["query_id"])
    order = F.dense_rank().over(Window.orderBy("query_id")) - 1
    return rrf(ranked.select(order.alias("list_no"), "pos", "item_id"))
