"""Tokens, search, packing, store and facade."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from agentlake.facade import Engine
from agentlake.functions import text as X
from agentlake.functions import tokens as T
from agentlake.functions.porter import stem
from agentlake.operators import assembly, search, store

M = "message_id string, conversation_id string, role string, content string, tokens long, sequence_num int, created_at long"


def _messages(spark, contents, tokens=10, conversation="c"):
    return spark.createDataFrame([(f"m{i}", conversation, "assistant" if i % 2 else "user", t, tokens, i, i * 1000) for i, t in enumerate(contents)], M)


def test_utf16_lengths_and_token_counts(spark):
    df = spark.createDataFrame([("a😀", "gpt"), ("x" * 7, "claude"), ("", "llama")], "t string, f string")
    out = df.select(X.utf16_length(F.col("t")).alias("n"), T.token_count(F.col("t"), F.col("f")).alias("c"), T.estimate_tokens(F.col("t"), F.col("f")).alias("e")).collect()
    assert [(r["n"], r["c"], r["e"]) for r in out] == [(3, 1, 1), (7, 2, 2), (0, 0, 0)]


def test_format_family_and_cache(spark):
    df = spark.createDataFrame([(999,), (1200,), (3_400_000,)], "n long")
    assert [r[0] for r in df.select(T.format_tokens(F.col("n"))).collect()] == ["999", "1.2K", "3.4M"]
    names = spark.createDataFrame([("Claude-x",), ("OpenAI o",), ("gemini",), ("LLAMA",), ("zz",)], "m string")
    assert [r[0] for r in names.select(T.model_family(F.col("m"))).collect()] == ["claude", "gpt", "gemini", "llama", "unknown"]
    rows = spark.createDataFrame([("abcd", "gpt"), ("abcd", "claude")], "content string, model_family string")
    cache = T.new_cache_rows(rows, spark.createDataFrame([], "content_hash string, family string, count long"))
    assert cache.count() == 2
    assert all(r["cached"] for r in T.count_with_cache(rows, cache).collect())
    assert T.clear_cache(cache, "gpt").count() == 1


def test_trim_takes_every_white_space(spark):
    assert spark.createDataFrame([("  \t x y \n",)], "t string").select(X.trim_all(F.col("t"))).first()[0] == "x y"


def test_porter_stems():
    pairs = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor hopping:hop filing:file happy:happi relational:relat conditional:condit triplicate:triplic hopeful:hope revival:reviv adoption:adopt rate:rate controll:control sky:sky running:run"
    for pair in pairs.split():
        word, want = pair.split(":")
        assert stem(word) == want, word


def test_bm25_against_the_formula(spark):
    texts = ["deploy the service", "the deployment of the api", "nothing here", "api api api deploy", "a", "b", "c"]
    out = {r["message_id"]: r["bm25"] for r in search.bm25(_messages(spark, texts), "API deploy?", stemmed=False).collect()}
    mean = sum(len(t.split()) for t in texts) / 7

    def part(tf, df, length):
        return math.log((7 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))

    assert out == {"m3": pytest.approx(part(3, 2, 4) + part(1, 2, 4))}
    stemmed = {r["message_id"] for r in search.bm25(_messages(spark, texts), "deployments").collect()}
    assert stemmed == {"m1"} or stemmed == {"m0", "m1", "m3"}
    assert search.bm25(_messages(spark, texts), "?!").count() == 0


def test_sparse_search_modes_filters_and_context(spark):
    m = _messages(spark, ["alpha beta", "alpha", "gamma", "alpha alpha beta beta", "delta", "x", "y", "z"])
    best = search.sparse_search(m, "alpha", 10_000, mode="bm25", stemmed=False).orderBy("pos").collect()
    assert [r["score"] for r in best] == sorted((r["score"] for r in best), reverse=True)
    assert {r["message_id"] for r in search.sparse_search(m, "alpha", 0, roles=["assistant"], stemmed=False).collect()} == {"m1", "m3"}
    assert {r["message_id"] for r in search.sparse_search(m, "alpha", 0, since=1000, until=1000, stemmed=False).collect()} == {"m1"}
    around = search.message_context(m, m.where("message_id = 'm1'").select("message_id"), 1, 2)
    assert sorted(r["message_id"] for r in around.collect()) == ["m0", "m1", "m2", "m3"]
    assert "m0" not in {r["message_id"] for r in search.find_similar(m, "m0", 0, stemmed=False).collect()}
    hybrid = search.hybrid_search(m, "alpha", 0, m.where("message_id = 'm4'").select("message_id", F.lit(1.0).alias("score")), stemmed=False)
    assert {"m4", "m1"} <= {r["item_id"] for r in hybrid.collect()}
    assert search.suggestions("al") == []


def test_packing_stops_at_the_first_that_does_not_fit(spark):
    m = spark.createDataFrame([("a", "c", "user", "x", 5, 0, 0), ("b", "c", "user", "x", 50, 1, 0), ("d", "c", "user", "x", 5, 2, 0)], M)
    assert [r["message_id"] for r in assembly.recent(m, 20).collect()] == ["d"]
    assert assembly.recent(m, 0).count() == 0
    assert assembly.estimate_message_count(m, 100).first()["messages"] == 3


def test_budget_is_monotonic_and_respected(spark):
    m = _messages(spark, ["t"] * 30)
    sizes = [assembly.recent(m, b).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] for b in (0, 9, 10, 95, 1000)]
    assert sizes == [0, 0, 10, 90, 300]


def test_strategies(spark):
    m = _messages(spark, [f"alpha word{i}" if i < 10 else f"other {i}" for i in range(20)])
    ids = lambda df: [r["message_id"] for r in df.collect()]
    assert ids(assembly.assemble(m, "recent", 30, 0, "c")) == ["m17", "m18", "m19"]
    mixed = ids(assembly.assemble(m, "hybrid", 100, 0, "c", "alpha", stemmed=False))
    assert mixed[-5:] == ["m15", "m16", "m17", "m18", "m19"]
    assert len(mixed) == 9
    assert len(ids(assembly.assemble(m, "full", 0, 0, "c"))) == 20
    with pytest.raises(ValueError, match="query"):
        assembly.assemble(m, "relevant", 10, 0, "c")
    with pytest.raises(ValueError, match="strategy"):
        assembly.assemble(m, "best", 10, 0, "c")


def test_sequence_goes_on_and_deleted_messages_are_counted(spark):
    m = _messages(spark, ["a", "b"])
    new = spark.createDataFrame([("c", 0, "user", "z", 3, 9), ("d", 0, "user", "z", 3, 9), ("c", 1, "user", "z", 3, 9)], "conversation_id string, position int, role string, content string, tokens long, created_at long")
    out = store.add_messages(m, new)
    assert sorted((r["conversation_id"], r["sequence_num"]) for r in out.collect()) == [("c", 0), ("c", 1), ("c", 2), ("c", 3), ("d", 0)]
    kept, lost = store.delete_messages(m, m.where("sequence_num = 0").select("message_id"))
    assert (kept.count(), lost.first()["removed_tokens"]) == (1, 10)


def test_overlay_health_and_status(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, v int")
    out = store.overlay(rows, spark.createDataFrame([(1, None, 7), (9, "x", 1)], "id int, name string, v int"), "id")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 7), (2, "b", 2)]
    assert store.health(0.1, 0.1, 0.9, 0, 0) == (100, "healthy")
    assert store.health(0.95, 0.95, 0.1, 900, 1000)[1] == "critical"
    stamps = spark.range(1).select(*(c.alias(n) for n, c in store.stamped(F.lit("acted"), F.lit(5)).items())).first()
    assert (stamps["acted_at"], stamps["presented_at"]) == (5, None)


def test_engine_lifecycle(spark, tmp_path):
    lines = [{"role": "user", "content": "deploy the api"}, {"role": "assistant", "content": [{"type": "text", "text": "First part"}, {"type": "image"}, {"type": "text", "text": "Second part"}]}, {"role": "user", "content": [{"type": "image"}]}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "session-s1.jsonl").write_text("\n".join([json.dumps(lines[0]), "", "{broken", *map(json.dumps, lines[1:])]))
    engine = Engine(spark, str(tmp_path / "store"))
    assert engine.bootstrap(str(tmp_path / "in"), 1000) == {"messages": 2, "conversations": 1}
    engine.bootstrap(str(tmp_path / "in"), 1000)
    engine.ingest("s1", "user", "and now the api tests", 2000)
    rows = engine.table("messages").orderBy("sequence_num").collect()
    assert [r["content"] for r in rows] == ["deploy the api", "First part\nSecond part", "and now the api tests"]
    out, meta = engine.assemble("s1", 2000, strategy="recent")
    assert (meta["included"], meta["truncated"]) == (3, False)
    assert engine.search("api", 2000, stemmed=False).count() == 2
    with pytest.raises(KeyError):
        engine.assemble("nope", 0)
    engine.record_compaction("s1", [rows[0]["message_id"]], "drop", 3000)
    event = engine.compaction_history("s1").first()
    assert (event["messages_before"], event["messages_after"]) == (3, 2)
    assert engine.stats()["compactions"] == 1
    assert engine.health_check()
