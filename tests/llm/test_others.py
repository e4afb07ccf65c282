"""Operators over pages and embeddings, and the pipeline, against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from agentlake.llm import jaccard, langid, tokens, urlfilter, vectordedup, warc
from agentlake.llm import queries as llm_queries

from .helpers import edited, frame, words

# URL filter (3)


def test_canonical_urls(spark):
    pairs = {
        "http://www.Example.com/a/?utm_source=x#top": "example.com/a", "https://example.com:443/a": "example.com/a", "example.com/a/index.html": "example.com/a", "HTTP://example.com": "example.com",
        "http://e.com/p?b=2&a=1&ref=z": "e.com/p?a=1&b=2", "  http://e.com/P/ ": "e.com/P", "http://e.com?x=1": "e.com?x=1", "": "",
    }
    df = spark.createDataFrame(list(pairs.items()), "url string, want string").withColumn("got", urlfilter.canonical(F.col("url")))
    assert [(r["url"], r["got"]) for r in df.collect()] == [(r["url"], r["want"]) for r in df.collect()]


@pytest.mark.parametrize("most", [urlfilter.MAX_BLOCKS, 0])
def test_filter_has_no_misses_and_no_false_positives(spark, most):
    """0: the blocks are joined by shuffle."""
    pages = spark.createDataFrame([(i, f"http://h{i % 97}.com/p{i}/", "x") for i in range(3000)], "page_id long, url string, _key string").withColumn("__url_0", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("canonical_url", F.lit(3)).withColumn("__url_gone", F.lit(4))
    listed = spark.createDataFrame([(f"https://www.h{i % 97}.com/p{i}?utm_medium=z",) for i in range(0, 6000, 7)], "url string")
    got = urlfilter.matches(pages, listed, most)
    assert {r["page_id"] for r in got.collect()} == set(range(0, 3000, 7))
    assert sorted(got.columns) == sorted(pages.columns)
    kept = urlfilter.drop_listed(pages, listed, most)
    assert kept.columns == pages.columns
    assert {r["page_id"] for r in kept.collect()} == set(range(3000)) - set(range(0, 3000, 7))


@pytest.mark.parametrize("most", [urlfilter.MAX_BLOCKS, 0])
def test_filter_rejects_nearly_all_that_is_not_listed(spark, most):
    keys = spark.range(20_000).select(F.concat(F.lit("e.com/"), "id").alias("key"), "id")
    listed = keys.where("id % 20 = 0").select("key")
    passed = {r["id"] for r in urlfilter.passing(keys, listed, "key", most).collect()}
    assert set(range(0, 20_000, 20)) <= passed
    assert len(passed) < 1000 + 0.03 * 19_000


def test_filter_awkward(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "http://a.com/"), (3, "http://a.com/"), (None, "a.com"), (4, "x" * 50_000)], "page_id long, url string")
    listed = spark.createDataFrame([(None,), ("",), ("a.com",), ("a.com",)], "url string")
    assert sorted((r["page_id"] for r in urlfilter.matches(pages, listed).collect()), key=str) == [3, 3, None]
    assert urlfilter.matches(pages, listed.limit(0)).count() == 0
    assert urlfilter.matches(pages.limit(0), listed).count() == 0
    assert sorted((r["page_id"] for r in urlfilter.drop_listed(pages, listed).collect()), key=str) == [1, 2, 4]


# Merkle fixity (10)


def _records(spark, rows):
    rows = spark.createDataFrame(rows, "number long, url string, payload string")
    text = warc.record(F.col("url"), F.col("payload"))
    return rows.withColumns({"hash": F.sha2(text, 256), "bytes": F.octet_length(text), "node": F.lit("clash"), "range": F.lit("clash"), "a.b": F.lit(1)})


def test_offsets_are_those_of_the_archive(spark):
    rows = [(i // 3 if i % 2 else i, f"http://a/{i}", "x" * (i % 50)) for i in range(900)] + [(7, "same", "same")] * 40
    got = sorted((r["offset"], r["number"], r["url"], r["payload"]) for r in warc.laid_out(_records(spark, [*rows, (None, "u", "p")])).collect())
    text = lambda u, p: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {u}\r\nContent-Length: {len(p)}\r\n\r\n{p}\r\n\r\n"
    order, at = sorted(rows, key=lambda r: (r[0], hashlib.sha256(text(*r[1:]).encode()).hexdigest())), 0
    for (offset, *row), want in zip(got, order, strict=True):
        assert offset == at and tuple(row) == want
        at += len(text(*want[1:]))


def test_audit_finds_exactly_the_faults(spark):
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * 20) for i in range(9000)]
    laid = warc.laid_out(_records(spark, rows))
    laid = warc.settle(laid.select("offset", "hash", "number"))
    at = {r["number"]: r["offset"] for r in laid.collect()}
    other = laid.where("number NOT IN (17, 8999)").withColumn("hash", F.when(F.col("number").isin(0, 63, 64, 4096), "wrong").otherwise(F.col("hash")))
    other = other.unionByName(spark.createDataFrame([(10**9, "new", 9500)], "offset long, hash string, number long"))
    got = {r["offset"]: (r["primary_hash"], r["replica_hash"]) for r in warc.audit(laid, other).collect()}
    assert set(got) == {at[i] for i in (0, 63, 64, 4096, 17, 8999)} | {10**9}
    assert got[at[17]][1] is None
    assert got[10**9] == (None, "new")
    assert warc.audit(laid, laid).count() == 0


def test_audit_awkward(spark):
    frame_of = lambda rows: spark.createDataFrame(rows, "offset long, hash string").withColumn("node", F.lit("clash"))
    a = frame_of([(1, "a"), (2, "b"), (None, "c"), (3, None), (4, "r"), (4, "r")])
    b = frame_of([(1, "x"), (2, "b"), (4, "r")])
    assert {r["offset"] for r in warc.audit(a, b).collect()} == {1, 4}
    assert warc.audit(a, a).count() == 0
    assert warc.audit(a.limit(0), b.limit(0)).count() == 0
    assert {r["offset"] for r in warc.audit(a, b.limit(0)).collect()} == {1, 2, 4}
    assert warc.laid_out(_records(spark, [(None, "u", "p")])).count() == 0
    hashes = {r["hash"] for r in _records(spark, [(1, None, ""), (1, "", ""), (1, "", None), (1, None, None)]).collect()}
    assert len(hashes) == 4


# Embeddings (9)


def _brute(x, threshold):
    """{row: (class, links)} by comparing all with all."""
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            return {i: (int(label[i]), int(near[i].sum())) for i in range(len(x))}
        label = new


def _vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def _classes(spark, x, **options):
    return {r["vec_id"]: (r["class_id"], r["links"]) for r in vectordedup.near_classes(_vectors(spark, x), 0.9, **options).collect()}


def test_graph_links_against_brute_force(spark, monkeypatch):
    """Groups too small for a ball; the audit does not come to all rows."""
    monkeypatch.setattr(vectordedup, "AUDIT", 300)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(1500, 24))
    near = np.concatenate([base[:20].repeat(6, axis=0) + 0.15 * rng.normal(size=(120, 24)), base[30:230] + 0.2 * rng.normal(size=(200, 24))])
    x = np.concatenate([base, near, base[30:40]]).astype(np.float32)
    got, want = _classes(spark, x, shard_rows=300), _brute(x, 0.9)
    assert got.keys() == want.keys()
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(n for _, n in got.values()) >= 0.97 * sum(n for _, n in want.values()) > 800


@pytest.mark.parametrize("rows", [4096, 40])
def test_balls_and_their_visitors_are_exact(spark, monkeypatch, rows):
    monkeypatch.setattr(vectordedup, "BALL_ROWS", rows)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 24))
    # Two tight groups close to each other, and vectors at every distance from them.
    other = base[0] + 0.45 * rng.normal(size=24)
    x = np.concatenate([base, base[0] + 0.06 * rng.normal(size=(300, 24)), other + 0.06 * rng.normal(size=(200, 24)), base[0] + np.linspace(0.05, 0.6, 150)[:, None] * rng.normal(size=(150, 24))]).astype(np.float32)
    x = np.concatenate([x, x[450:470]])
    got = _classes(spark, x)
    assert got == _brute(x, 0.9)
    balls = vectordedup.crowded(x[:900] / np.linalg.norm(x[:900], axis=1, keepdims=True), float(np.cos(np.arccos(0.9) / 2)))
    assert 1 <= len(balls) < 10
    assert max(n for _, n in got.values()) > 300


def test_below_the_target_the_join_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vectordedup, "ATTEMPTS", ())
    monkeypatch.setattr(vectordedup, "AUDIT", 300)
    monkeypatch.setattr(vectordedup, "BLOCK_ROWS", 900)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(1500, 64))
    x = np.concatenate([base, base[:300] + 0.44 * rng.normal(size=(300, 64))]).astype(np.float32)
    assert _classes(spark, x, shard_rows=300) == _brute(x, 0.9)


def test_links_across_shards(spark):
    rows = [(1, [1.0, 0.0, 0.0], [1, 2]), (2, [0.95, 0.3, 0.0], [2, 3]), (3, [0.9, 0.43, 0.0], [3, 4]), (4, [0.0, 0.0, 1.0], [4, 5])]
    placed = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shards array<long>")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert sorted(map(tuple, vectordedup._across(pairs, placed, 0.9).collect())) == [(1, 2), (1, 3), (2, 3)]
    assert sorted(map(tuple, vectordedup._across(pairs, placed, 0.95).collect())) == [(1, 2), (2, 3)]


def test_near_classes_awkward(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [1.0, None]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shards", F.lit(0)).withColumn("times", F.lit(0)).withColumn("a.b", F.lit(0))
    got = {r["vec_id"]: (r["class_id"], r["links"]) for r in vectordedup.near_classes(df).collect()}
    assert got == {i: (i, 0) for i in range(4, 11)} | {i: (1, 2) for i in (1, 2, 3)}
    assert vectordedup.near_classes(df.limit(0)).count() == 0
    assert {r["links"] for r in vectordedup.near_classes(df.where("vec_id IN (4, 5)")).collect()} == {0}


# Pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = []
    for d in range(120):
        base = words(d // 3, 80)
        text = edited(base, d % 3, d) if d % 3 < 2 else words(5000 + d, 60)
        rows.append((d, " ".join(text), "en" if d % 2 else "xx", f"s{d % 3}"))
    rows.append((900, "!!!", None, "s0"))
    item = words(77, 20)
    rows.append((901, " ".join(words(6000, 40) + item + words(6001, 40)), "en", "s1"))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = {}
    for r in out:
        for doc, ids in tokens.documents_of(r):
            found[doc] = ids
    texts = {d: t for d, t, *_ in rows}
    sets = {d: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for d, t in texts.items()}
    near = {(a, b) for a in texts for b in texts if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    want = set(texts) - {b for _, b in near} - {900, 901}
    assert set(found) == want
    from agentlake.llm import bpe

    assert all(bpe.encoding().decode(found[d].tolist()) == texts[d] for d in want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontaminate", "mixed", "token_ids"]


def test_every_operator_has_its_query():
    assert {q.split("_")[0] for q in llm_queries.QUERIES} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
    assert set(llm_queries.ORACLE) == {"op3_url_filter", "op7_ngram_jaccard", "op9_embedding_near_copies", "op10_warc_fixity"}
    assert jaccard.THRESHOLD and langid.FIT_DOCS
