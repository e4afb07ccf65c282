"""Entities, relationships, traversal, vectors, summaries, preferences, updates and queues."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentlake.operators import entities as E
from agentlake.operators import graph, preferences, summaries, updates, vectors
from agentlake.streaming import queues

CHATS = Path("/root/testdata/sf0.001")
M = "message_id string, conversation_id string, role string, content string, tokens long, sequence_num int, created_at long"


def _messages(spark, rows, gap=30_000):
    return spark.createDataFrame([(f"m{i}", "c", r, t, 10, i, i * gap) for i, (r, t) in enumerate(rows)], M)


def test_extraction_by_type(spark):
    text = "Meeting with nobody. meeting with Alice Smith about database design.\nWe decided to use Spark! TODO: write tests.\n- [ ] ship it\nHow do we deploy this thing?\n#infra project Apollo and ABC-12 done @bob the"
    out = {(r["entity_type"], r["canonical_name"]) for r in E.extract(_messages(spark, [("user", text)])).collect()}
    assert {("person", "alice smith"), ("person", "bob"), ("decision", "use Spark"), ("action", "write tests"), ("action", "ship it"), ("topic", "infra"), ("topic", "database"), ("topic", "database design"), ("project", "abc-12")} <= out
    assert ("question", "How do we deploy this thing?") in out
    assert not any(n in E.NOISE for _, n in out)


def test_entity_ids_and_merging(spark):
    out = E.extract(_messages(spark, [("user", "@Bob and @bob"), ("user", "@BOB")])).collect()
    assert len(out) == 1
    assert (out[0]["name"], out[0]["mention_count"], out[0]["aliases"]) == ("Bob", 3, ["BOB", "bob"])
    import hashlib

    assert out[0]["entity_id"] == "person_" + hashlib.sha256(b"person:bob").hexdigest()[:16]


def test_resolution(spark):
    people = E.extract(_messages(spark, [("user", "spoke with Bob Smith, call with Robert Smith. @alice")]))
    out = {r["canonical_name"]: r["merged_entities"] for r in E.resolve_people(people).collect()}
    assert out == {"robert smith": 2, "alice": 1}
    assert len(E.NICKNAMES) == 39
    assert E.similar_topics("api design", "api design v2")
    assert not E.similar_topics("api", "api design guide")
    assert E.similar_topics("databases", "databasez")
    assert E.similar_projects("Apollo", "apollo two")
    topics = spark.createDataFrame([("c", "t1", "topic", "testing", "testing", 2, 0.9, 1, 2), ("c", "t2", "topic", "testings", "testings", 1, 0.8, 2, 3), ("c", "t3", "topic", "rest", "rest", 1, 0.8, 3, 3)], "conversation_id string, entity_id string, entity_type string, name string, canonical_name string, mention_count long, confidence double, first_mentioned long, last_mentioned long")
    out = {r["name"]: r["mention_count"] for r in E.resolve_names(topics, "topic").collect()}
    assert out == {"testings": 3, "rest": 1}


def test_message_edges(spark):
    m = _messages(spark, [("user", "is it done?"), ("assistant", "yes"), ("assistant", "also this is a much longer message that goes past fifty characters"), ("user", "as you mentioned, fine")])
    out = {(r["source_id"], r["target_id"]): (r["relationship_type"], r["strength"]) for r in graph.message_edges(m).collect()}
    assert out[("m1", "m0")] == ("answers", 0.8)
    assert out[("m2", "m1")] == ("continues", 0.75)
    assert all(out[("m3", f"m{i}")] == ("references", 0.9) for i in range(3))


def _edges(spark, rows):
    return spark.createDataFrame([("entity", a, "entity", b, k, s, 0) for a, b, k, s in rows], "source_type string, source_id string, target_type string, target_id string, relationship_type string, strength double, created_at long")


def test_traversal_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(f"n{a}", f"n{b}", "relates_to", float(s)) for a, b, s in zip(rng.integers(0, 40, 60), rng.integers(0, 40, 60), rng.random(60).round(3), strict=True)]
    near = {}
    for a, b, _, s in rows:
        if s >= 0.5:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    depth, frontier = {"n1": 0}, ["n1"]
    for d in range(1, 4):
        frontier = [y for y in {y for x in frontier for y in near.get(x, ())} if y not in depth]
        depth |= dict.fromkeys(frontier, d)
    starts = spark.createDataFrame([("entity:n1",)], "node string")
    got = {r["node"].split(":")[1]: (r["depth"], len(r["path"])) for r in graph.related(_edges(spark, rows), starts).collect()}
    assert got == {k: (d, d) for k, d in depth.items()}


def test_paths_neighbours_measures(spark):
    e = _edges(spark, [("a", "b", "relates_to", 0.9), ("b", "c", "relates_to", 0.8), ("c", "d", "mentions", 0.4), ("a", "a", "relates_to", 0.6)])
    assert graph.shortest_path(e, "entity:a", "entity:c") == ["entity:a", "entity:b", "entity:c"]
    assert graph.shortest_path(e, "entity:a", "entity:d") is None
    assert [r["other"] for r in graph.neighbours(e, "entity:b").collect()] == ["entity:a", "entity:c"]
    d = graph.density(e).first()
    assert (d["nodes"], d["edges"], d["density"]) == (4, 4, pytest.approx(8 / 12))
    names = spark.createDataFrame([(x, x, "topic") for x in "abcdz"], "entity_id string, name string, entity_type string")
    c = {r["entity_id"]: r["degree"] for r in graph.centrality(e, names).collect()}
    assert c == {"a": 2, "b": 2, "c": 2, "d": 1, "z": 0}
    assert [r["entity_id"] for r in graph.strongly_connected(e, names, "entity:b").collect()] in (["a", "c"], ["c", "a"])


def test_build_and_clear(spark):
    m = _messages(spark, [("user", "@ann @bea decided to go to project Apollo"), ("assistant", "@ann says hello")])
    found, edges = graph.build(m)
    assert edges.where("strength < 0.5").count() == 0
    assert {"mentions", "decision_about"} <= {r["relationship_type"] for r in edges.collect()}
    rest, left = graph.without_conversation(found, edges, m, "c")
    assert (rest.count(), left.where("relationship_type = 'mentions'").count()) == (0, 0)
    assert graph.mean_confidence(rest).first()[0] == 1.0


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in vectors.search(v, [2.1, 0.0], 2, 0.0, [2], "vec_id").collect()] == [3, 1]
    many = vectors.search_many(v, v, 1)
    assert {r["query_id"]: r["found_id"] for r in many.collect()}[0] == 1
    new = spark.createDataFrame([(0, [9.0, 9.0], 0), (0, [8.0, 8.0], 1), (7, [1.0], 2)], "message_id long, embedding array<double>, position int")
    kept, rejected = vectors.add(v.withColumnRenamed("vec_id", "message_id"), new, 2)
    assert (kept.count(), rejected.count()) == (6, 1)
    assert kept.where("message_id = 0").first()["embedding"] == [8.0, 8.0]
    texts = spark.createDataFrame([("a",), ("",)], "t string")
    out = texts.select(vectors.EmbeddingGenerator().column(F.col("t")).alias("e")).collect()
    raw = np.sin(97 + np.arange(128)) * 0.5 + 0.5
    assert out[0]["e"] == pytest.approx((raw / np.linalg.norm(raw)).tolist())


def test_windows_and_compression(spark):
    m = _messages(spark, [("user", f"message {i}") for i in range(53)])
    sizes = [r["messages"] for r in summaries.window_summaries(m).orderBy("window_no").collect()]
    assert sizes == [20, 20, 2, 5, 5, 1]
    long = "Intro here.\n\n" + " ".join(f"We decided that the plan number {i} is good." for i in range(200))
    short = summaries.compress(long, 100)
    assert len(short) <= 420
    assert summaries.compress("short", 100) == "short"
    assert summaries.remove_fillers("the cat is on the mat of the house") == "the cat mat house"
    out = summaries.summarise(m, 1000, 50).first()
    assert out["token_count"] <= 60
    assert out["valid_until"] == 1000 + summaries.TTL
    assert summaries.coarser("detailed") == "medium"
    assert summaries.view_budgets(100)["detail"] == 50


def test_preferences(spark):
    m = _messages(spark, [("user", "python and django, Python! backend `x`?")] * 6)
    tech = {r["value"]: (r["evidence_count"], r["confidence"]) for r in preferences.technologies(m).collect()}
    assert tech == {"Python": (12, 1.0), "Django": (6, 0.6)}
    assert preferences.roles(m).first()["role"] == "backend_developer"
    assert preferences.domains(m).count() == 0
    style = preferences.communication_style(m).first()
    assert (style["style"], style["code_heavy"], style["inquisitive"]) == ("concise", True, True)
    a = spark.createDataFrame([("language", "Python", 4, 0.4, 1, 5)], "category string, value string, evidence_count long, confidence double, first_observed long, last_observed long")
    b = a.withColumn("confidence", F.lit(0.8)).withColumn("first_observed", F.lit(3)).withColumn("last_observed", F.lit(9))
    out = preferences.merge_with_existing(a, b).first()
    assert (out["evidence_count"], round(out["confidence"], 6), out["first_observed"], out["last_observed"]) == (8, 0.7, 1, 9)


def test_updates(spark):
    m = _messages(spark, [("user", "old"), ("user", "URGENT: please look. Now"), ("user", "I am stuck"), ("user", "deadline nears"), ("user", "fine")])
    out = updates.updates_since(m, None, 0).collect()
    assert [(r["category"], r["priority"]) for r in out] == [("urgent", 10), ("urgent", 9), ("blocking", 8), ("informational", 5)]
    assert out[0]["description"] == "URGENT: please look."
    text = {r["category"]: r["text"] for r in updates.update_text(updates.updates_since(m, None, 0)).collect()}
    assert text["urgent"] == "- URGENT: please look.\n- deadline nears"


T = "task_id string, key string, priority string, status string, attempts int, created_at long, updated_at long"


def test_queue_lifecycle(spark, tmp_path):
    empty = spark.createDataFrame([], T)
    new = spark.createDataFrame([("a", "low", 1), ("b", "urgent", 2), ("a", "urgent", 3), ("d", "normal", 1)], "key string, priority string, created_at long")
    tasks = queues.enqueue(empty, new, new.where("key = 'd'"))
    assert [r["key"] for r in queues.next_batch(tasks).collect()] == ["b", "a"]
    assert queues.enqueue(tasks, new.where("key = 'a'")).count() == 0
    for i in range(3):
        tasks = queues.settle_batch(tasks, tasks.select("task_id", (F.col("key") == "b").alias("ok")).where(F.lit(i == 0) | ~F.col("ok")), i)
    assert {r["key"]: (r["status"], r["attempts"]) for r in tasks.collect()} == {"a": ("failed", 3), "b": ("completed", 1)}
    assert queues.next_batch(queues.retry_failed(tasks)).count() == 1
    assert queues.clear(tasks).count() == 1
    before = spark.createDataFrame([("x", 1), ("y", 1)], "path string, mtime long")
    after = spark.createDataFrame([("y", 2), ("z", 1)], "path string, mtime long")
    assert {(r["path"], r["event"]) for r in queues.changes(before, after).collect()} == {("x", "unlink"), ("y", "change"), ("z", "add")}


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.txt").write_text("one")
    (source / ".hidden.txt").write_text("no")
    for i in range(2):
        stream = queues.watch_files(spark, str(source), "*.txt").select(F.col("value").alias("message_id"))
        query = queues.ingest_stream(stream, out, str(tmp_path / f"check{i}"))
        query.awaitTermination(60)
        (source / "b.txt").write_text("two")
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == ["one", "two"]


def test_many_searches_hold_few_distances_and_settle_ties(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[100:140] = x[5]  # ties, which go by id
    want = {}
    for i in range(300):
        d = np.sqrt(((x[i] - x) ** 2).sum(1))
        want[i] = sorted((round(v, 9), j) for j, v in enumerate(d) if j != i)[:5]
    sizes = []
    monkeypatch.setattr(vectors, "CELLS", 1_000)
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda d, *a, **k: sizes.append(d.size) or partition(d, *a, **k))

    import pyarrow as pa

    class Sent:
        value = (np.arange(300), x)

    batch = pa.RecordBatch.from_pydict({"vec_id": np.arange(300), "embedding": pa.array(x.tolist())})
    got = {}
    for out in vectors._nearest(Sent, 5, "vec_id")([batch]):
        for r in out.to_pylist():
            got.setdefault(r["query_id"], []).append((round(r["distance"], 9), r["found_id"]))
    assert {i: sorted(v) for i, v in got.items()} == want
    assert max(sizes) <= 1_000
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    rows = vectors.search_many(v.repartition(3), v, 5, at_once=100).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["found_id"]) for r in rows] == [(i, j) for i in range(300) for _, j in want[i]]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_predecessors_move_each_message_once(spark):
    m = _messages(spark, [("user", f"@ann{i % 3} and @bob") for i in range(15)])
    plan = _plan(graph.message_edges(m))
    assert "Join" not in plan
    assert "content" not in plan[: plan.index("Window")]
    per = E.merged(E.mentions(m), ["message_id"])
    assert _plan(graph.overlap_edges(m, per)).count("Join") == 1
    sets = [{f"ann{i % 3}", "bob"} for i in range(15)]
    want = {(f"m{i}", f"m{j}", round(0.7 * len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 6)) for i in range(15) for j in range(max(0, i - 10), i)}
    assert {(r["source_id"], r["target_id"], round(r["strength"], 6)) for r in graph.overlap_edges(m, per).collect()} == want
    pairs = {(r["message_id"], r["prev_message_id"], r["prev_n"]) for r in graph.predecessors(m, 10).collect()}
    assert pairs == {(f"m{i}", f"m{j}", j + 1) for i in range(15) for j in range(max(0, i - 10), i)}


def test_edges_within_messages_read_texts_once(spark):
    m = _messages(spark, [("user", "@ann @bea decided to go to project Apollo"), ("assistant", "TODO: project Apollo-Two, @ann"), ("user", "nothing")])
    per = E.merged(E.mentions(m), ["message_id"])
    both = graph.within_message(per)
    assert "Join" not in _plan(both)
    assert _plan(both).count("Union") == 0
    rows = [r.asDict() for r in per.collect()]
    want = {("message", r["message_id"], r["entity_id"], "mentions", r["confidence"]) for r in rows}
    for a in rows:
        for b in rows:
            if a["message_id"] == b["message_id"]:
                if a["position"] < b["position"]:
                    want.add(("entity", a["entity_id"], b["entity_id"], "relates_to", min(a["confidence"], b["confidence"]) * 0.6))
                if a["entity_type"] == "decision" and b["entity_type"] in ("topic", "project"):
                    want.add(("entity", a["entity_id"], b["entity_id"], "decision_about", 0.75))
                if a["entity_type"] == "action" and b["entity_type"] == "project":
                    want.add(("entity", a["entity_id"], b["entity_id"], "action_item", 0.8))
    assert {(r["source_type"], r["source_id"], r["target_id"], r["relationship_type"], r["strength"]) for r in both.collect()} == want
    assert {"decision_about", "action_item"} <= {w[3] for w in want}


def test_built_entities_come_from_one_look_at_the_texts(spark):
    m = _messages(spark, [("user", "@Ann and @ann, project Apollo"), ("assistant", "@ANN: project  Apollo"), ("user", "@bob")])
    found, _ = graph.build(m)
    assert "regexp_extract_all" not in _plan(found)
    columns = sorted(found.columns)
    assert sorted(map(repr, found.select(columns).collect())) == sorted(map(repr, E.extract(m).select(columns).collect()))
    assert _plan(E.resolve(E.merged(E.mentions(m), ["conversation_id"]))).count("regexp_extract_all") == 0


def test_quick_trims_are_those_of_the_regular_expressions(spark):
    from agentlake.functions import text as T

    odd = [chr(c) for c in [*range(1, 0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1F600]]
    names = ["", " ", "a  b", *(x for c in odd for x in (c, f"{c}a b", f"a b{c}", f"a{c} b"))]
    rows = spark.createDataFrame([(x,) for x in names], "t string")
    t = F.col("t")
    assert rows.where((T.trim_name(t) != T.trim_all(t)) | (T.squeeze_name(t) != T.squeeze(t))).count() == 0


def test_detail_view_does_not_shuffle_texts(spark):
    m = _messages(spark, [("user", f"@ann the plan that {i}") for i in range(5)])
    found, edges = graph.build(m)
    out = summaries.detail_view(m, edges, found, "the that", 10_000_000, stemmed=False)
    assert _plan(out).count("strategy=broadcast") == 2
    assert out.count() > 0


@pytest.mark.skipif(not CHATS.exists(), reason="the test tables are not here")
def test_relationships_without_names_read_texts_once(spark):
    from agentlake.plans import graph_queries, registry  # noqa: F401

    plan = _plan(registry.QUERIES["graph_relationships"](spark, str(CHATS)))
    assert (plan.count("parquet"), plan.count("Join")) == (1, 0)
    assert 0 < plan.index("Sort") < plan.index("RepartitionByExpression [source_id") < plan.index("Generate")
    m = _messages(spark, [("user", "@ann @bea decided to go to project Apollo"), ("assistant", "TODO: project Apollo-Two, @ann")])
    found, edges = graph.build(m)
    named, plain = graph.relationships(edges, found, None, 0.5), graph.relationships(edges, None, None, 0.5)
    assert {"source_name", "target_name"} <= set(named.columns)
    assert plain.collect() == named.drop("source_name", "target_name").collect() != []
    strengths = [r["strength"] for r in plain.collect()]
    assert strengths == sorted(strengths, reverse=True)


@pytest.mark.skipif(not CHATS.exists(), reason="the test tables are not here")
def test_graph_stats_from_edges_read_texts_once(spark):
    from agentlake.plans import graph_queries, registry  # noqa: F401

    plan = _plan(registry.QUERIES["graph_stats"](spark, str(CHATS)))
    assert (plan.count("parquet"), plan.count("Join")) == (1, 0)
    found = E.mentions(_messages(spark, [("user", "@ann @bea decided to go to project Apollo"), ("assistant", "TODO: project Apollo-Two, @ann"), ("user", "#infra, how do we ship this?")]))
    edges = graph.within_message(E.merged(found, ["message_id"]))
    one, two = graph.graph_stats(E.merged(found), edges), graph.graph_stats(None, edges)
    assert one.schema.names == two.schema.names
    assert two.first().asDict() == pytest.approx(one.first().asDict())
    assert min(two.first()[f"{t}s"] for t in ("person", "topic", "decision", "action", "question", "project")) > 0
    assert two.first()["edges"] > two.first()["entities"]
    none = edges.where("false")
    assert graph.graph_stats(None, none).first() == graph.graph_stats(E.merged(found).where("false"), none).first()


def test_times_of_long_chats_do_not_overflow(spark, tmp_path):
    from agentlake.plans import inputs

    orders = spark.range(90_000).select(F.col("id").alias("o_orderkey"), F.lit(7).cast("long").alias("o_custkey"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    last = inputs.chats(spark, str(tmp_path)).agg(F.max("created_at")).first()[0]
    assert last == inputs.START + 7 * 3_600_000 + 89_999 * 25_000
