"""Rank fusion, decay, diversity and evaluation, against values worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from agentlake.operators import ranking

DAY = ranking.DAY
ROWS = "item_id string, conversation_id string, created_at long, pos int, score double"


def _lists(spark, *lists):
    return spark.createDataFrame([(n, p, i) for n, items in enumerate(lists) for p, i in enumerate(items)], "list_no int, pos int, item_id string")


def test_rrf_sums_and_breaks_ties_by_first_appearance(spark):
    out = ranking.rrf(_lists(spark, ["m1", "m2", "m3"], ["m2", "m1", "m4"])).orderBy("rank").collect()
    assert [r["item_id"] for r in out] == ["m1", "m2", "m3", "m4"]
    assert out[0]["score"] == pytest.approx(1 / 61 + 1 / 62)


def test_rrf_counts_a_repeated_item_twice_and_keeps_one_row(spark):
    out = ranking.rrf(_lists(spark, ["a", "b", "a"])).orderBy("rank").collect()
    assert [(r["item_id"], r["rank"]) for r in out] == [("a", 1), ("b", 2)]
    assert out[0]["score"] == pytest.approx(1 / 61 + 1 / 63)


def test_weighted_rrf_normalises_and_limits(spark):
    rows = _lists(spark, ["a", "b"], ["b", "c"]).withColumn("source", F.when(F.col("list_no") == 0, "fts").otherwise("vec")).withColumn("weight", F.when(F.col("list_no") == 0, 0.0).otherwise(3.0))
    out = ranking.weighted_rrf(rows, limit=2).orderBy("rank").collect()
    assert [r["item_id"] for r in out] == ["b", "c"]
    assert out[0]["score"] == pytest.approx(0.25 / 62 + 0.75 / 61)
    assert out[0]["sources"] == "fts+vec"


def test_weighted_average_of_one_score_is_unchanged(spark):
    rows = spark.createDataFrame([(0, 0, "a", 0.4, 1.0), (1, 0, "a", 9.0, 1.0), (1, 1, "b", 3.0, 1.0)], "list_no int, pos int, item_id string, score double, weight double")
    out = {r["item_id"]: r["score"] for r in ranking.weighted_average(rows).collect()}
    assert out == {"a": pytest.approx((0.4 + 1.0) / 2), "b": 0.0}


def test_decay_halves_at_the_half_life(spark):
    rows = spark.createDataFrame([("a", "c", 0, 0, 0.8), ("b", "c", 30 * DAY, 1, 0.5)], ROWS)
    out = {r["item_id"]: r for r in ranking.temporal_decay(rows, 30 * DAY).collect()}
    assert out["a"]["score"] == pytest.approx(0.4)
    assert (out["b"]["rank"], out["a"]["rank"]) == (1, 2)
    assert all(math.isnan(r["score"]) for r in ranking.temporal_decay(rows, DAY, 0).collect())


def test_diversity_lowers_later_messages_of_a_conversation(spark):
    rows = spark.createDataFrame([("a", "x", 0, 0, 0.9), ("b", "x", 0, 1, 0.85), ("c", "y", 0, 2, 0.84)], ROWS)
    out = ranking.diversify(rows, 0.5).orderBy("rank").collect()
    assert [r["item_id"] for r in out] == ["a", "c", "b"]
    assert out[2]["score"] == pytest.approx(0.85 * 0.75)
    assert [r["original_rank"] for r in out] == [1, 3, 2]


def test_rerank_without_decay_and_diversity_is_the_list(spark):
    rows = spark.createDataFrame([("a", "x", 0, 0, 0.9)], ROWS)
    assert ranking.rerank(rows, 0, 0, 0).columns == rows.columns


def test_top_per_conversation_keeps_the_order(spark):
    rows = spark.createDataFrame([(str(i), "x" if i < 5 else "y", 0, i, 1.0) for i in range(7)], ROWS)
    assert [(r["item_id"], r["rank"]) for r in ranking.top_per_conversation(rows, 2).orderBy("rank").collect()] == [("0", 1), ("1", 2), ("5", 3), ("6", 4)]


def test_mrr_and_ndcg(spark):
    results = spark.createDataFrame([("q", p, i) for p, i in enumerate("abc")] + [("z", 0, "a")], "query_id string, pos int, item_id string")
    relevant = spark.createDataFrame([("q", "b"), ("q", "c")], "query_id string, item_id string")
    assert {r["query_id"]: r["mrr"] for r in ranking.mrr(results, relevant, ["query_id"]).collect()} == {"q": 0.5, "z": 0.0}
    graded = spark.createDataFrame([("q", "a", 3), ("q", "b", 2), ("q", "c", 1)], "query_id string, item_id string, relevance int")
    out = {r["query_id"]: r["ndcg"] for r in ranking.ndcg(results, graded, ["query_id"]).collect()}
    assert out == {"q": pytest.approx(1.0), "z": 0.0}
    worst = spark.createDataFrame([("q", p, i) for p, i in enumerate("cba")], "query_id string, pos int, item_id string")
    got = ranking.ndcg(worst, graded, ["query_id"]).first()["ndcg"]
    assert got == pytest.approx((1 + 2 / math.log2(3) + 3 / 2) / (3 + 2 / math.log2(3) + 1 / 2))


def test_explained_scores_are_rounded_by_their_exact_values(spark):
    rows = spark.createDataFrame([(1, 0.00035, None), (2, 0.03125, 2.5), (3, 0.28125, -0.00005)], "n int, a double, b double")
    none = F.lit(None).cast("double")
    out = [r["t"] for r in rows.orderBy("n").select(ranking.explain(F.col("a"), none, none, F.col("b")).alias("t")).collect()]
    assert out == ["Score: %.4f" % 0.00035, "Score: %.4f | Recency: 2.5000" % 0.03125, "Score: 0.2812 | Recency: %.4f" % -0.00005]
