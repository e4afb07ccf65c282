"""Operators over documents, against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import math
import pickle
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentlake.llm import bpe, decontam, jaccard, langid, mixing, tokencount, tokens, toxicity
from agentlake.llm import textvec as tv

from .helpers import DOCS, awkward, edited, frame, words


def _shingles(text, n):
    w = [x for x in "".join(c.lower() if c.isalnum() or c == "_" else " " for c in text).split()]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


# Token shards (1)


def test_elias_fano_select_and_values():
    rng = np.random.default_rng(0)
    for n, top in ((1, 0), (1, 10**6), (5, 3), (1000, 10**7), (1000, 10), (70, 64), (64, 100)):
        values = np.sort(rng.integers(0, top + 1, n))
        ef = tokens.EliasFano.of(values)
        again = tokens.EliasFano(n, *ef.parts())
        assert again.values().tolist() == values.tolist()
        assert [again.select(i) for i in range(n)] == values.tolist()
        with pytest.raises(IndexError):
            again.select(n)
    assert tokens.EliasFano.of(np.array([], np.int64)).count == 0
    with pytest.raises(ValueError, match="rise"):
        tokens.EliasFano.of(np.array([2, 1]))
    dense = tokens.EliasFano.of(np.cumsum(rng.integers(0, 2000, 10_000)))
    assert sum(map(len, dense.parts()[1:])) * 8 < 10_000 * 14


def test_shards_round_trip(spark):
    rows = [(i, " ".join(words(i, i % 90)), "en", "a") for i in range(200)]
    out = tokens.shards(frame(spark, rows), shard_tokens=500).collect()
    assert len(out) > 4
    decode = bpe.encoding().decode
    texts = {d: decode(ids.tolist()) for r in out for d, ids in tokens.documents_of(r)}
    assert texts == {i: t for i, t, *_ in rows}
    assert all(r["tokens"] == len(r["ids"]) // r["id_bytes"] for r in out)


def test_shards_awkward(spark):
    out = tokens.shards(awkward(spark)).collect()
    assert sum(r["docs"] for r in out) == 11
    found = [(d, bpe.encoding().decode(ids.tolist())) for r in out for d, ids in tokens.documents_of(r)]
    assert sorted(found, key=repr) == sorted(((r["doc_id"], r["text"] or "") for r in awkward(spark).collect()), key=repr)
    assert tokens.shards(spark.createDataFrame([], DOCS)).count() == 0


# Decontamination (2)


def _edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        last, row = row, [i]
        for j, y in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


def test_edit_distance_is_exact():
    rng = random.Random(3)
    for _ in range(500):
        p, t = [rng.randrange(4) for _ in range(rng.randrange(1, 12))], [rng.randrange(4) for _ in range(rng.randrange(15))]
        assert decontam.edit_distance(p, t, 20) == _edits(p, t)


def test_decontamination_against_brute_force(spark):
    items = {i: words(1000 + i, 10 + 3 * i) for i in range(20)}
    rows, rng = [], random.Random(5)
    for d in range(300):
        text = words(d, rng.randrange(0, 120))
        if d % 2 == 0:
            item = items[d // 2 % 20]
            at = rng.randrange(len(text) + 1)
            text = text[:at] + edited(item, rng.randrange(0, len(item) // 10 + 3), d) + text[at:]
        rows.append((d, " ".join(text), "en", "a"))
    bench = spark.createDataFrame([(i, " ".join(w).upper() + "!") for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.contaminated(frame(spark, rows), bench).collect()}
    want = {}
    for d, text, *_ in rows:
        for i, w in items.items():
            e = _edits(w, text.split())
            if e <= len(w) // 10:
                want[d, i] = e
    assert set(got) <= set(want)
    assert all(want[k] == v for k, v in got.items())
    assert len(got) >= 0.95 * len(want) > 50


@pytest.mark.parametrize("kind", ["mixed", "deletions"])
def test_decontamination_of_long_items(spark, kind):
    rng = random.Random(8)
    items = {i: words(3000 + i, n) for i, n in enumerate((64, 100, 150, 200, 300, 400) * 10)}
    rows = []
    for i, item in items.items():
        gone = set(rng.sample(range(len(item)), len(item) // 10)) if kind == "deletions" else ()
        text = [w for j, w in enumerate(item) if j not in gone] if gone else edited(item, len(item) // 10, i)
        rows.append((i, " ".join(words(7000 + i, 90) + text + words(8000 + i, 90)), "en", "a"))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.contaminated(frame(spark, rows), bench).collect()}
    assert all(d == i and got[d, i] == _edits(items[i], rows[d][1].split()) for d, i in got)
    assert len(got) >= 0.97 * len(items)


def test_decontamination_awkward(spark):
    bench = spark.createDataFrame([(1, "same text for all of us here"), (2, None), (3, ""), (None, "x " * 20), (4, " ".join(words(1, 30))), (4, " ".join(words(1, 30)))], "item_id long, text string")
    docs = awkward(spark).withColumn("a.b", F.lit(1)).withColumn("__leak_hit", F.lit(1)).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()) == [(4, 4), (5, 1), (6, 1)]
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == 7
    assert decontam.keep_clean(docs, bench, min_words=8).count() == 10
    empty = spark.createDataFrame([], DOCS)
    assert decontam.contaminated(empty, bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_short_items_are_found_everywhere(spark):
    items = {n: [f"q{n}", *words(40 + n, n - 1, 50)] for n in range(1, 13)}
    rows = []
    for d in range(240):
        n = d % 12 + 1
        text = words(d, 40, 50)
        rows.append((d, " ".join([*text[: d % 41], *items[n], *text[d % 41 :]] if d // 12 % 2 else [*text, *items[n][:-1]]), "en", "a"))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.contaminated(frame(spark, rows), bench).collect()}
    want = {(d, n): e for d, text, *_ in rows for n, w in items.items() if (e := _edits(w, text.split())) <= n // 10}
    assert got == want
    assert {n for _, n in want} == set(items)


def test_index_of_many_items_is_small():
    rng = random.Random(2)
    index = decontam.Index([(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(10 + i % 50))) for i in range(5000)], 0.1, decontam.REPETITIONS)
    assert len(pickle.dumps(index)) < 10_000_000


# Toxicity (4)


def _plain_votes(text, mined):
    """Voter by voter, with Python's own strings."""
    w = "".join(c.lower() if c.isalnum() or c == "_" else " " for c in text).split()
    out = [any(x in entry.split() for x in w) for entry in toxicity.LEXICONS]
    out.append(any(f" {p} " in f" {' '.join(w)} " for p in toxicity.PHRASES))
    out.append(sum(c != c.lower() for c in text) > 0.4 * max(len(text), 1))
    out.append(text.count("!") > 0.1 * max(len(w), 1))
    return out + [x in w if kind == "word" else sum(v.startswith(x) and len(v) > len(x) for v in w) > 1 for x, kind in mined]


def test_votes_moments_and_posteriors_against_plain_ones(spark):
    rng = random.Random(3)
    pool = ["idiot", "stupid", "clown", "scum", "trash", "zorkaa", "zorkab", "zorkabc", "blub", "SHUT", "up", "!", *words(1, 20)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 14))) for _ in range(300)] + ["", "SHOUTING ALL DAY!"]
    mined = [("zorka", tv.Words(["zorka"]).hash[0] ^ toxicity._BEGINNING), ("blub", tv.Words(["blub"]).hash[0])]
    voters = toxicity.lexicon(mined)
    found = toxicity.votes(tv.Words(texts), voters)
    plain = np.array([_plain_votes(t, [("zorka", "prefix"), ("blub", "word")]) for t in texts])
    assert (found == plain).all()
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).select("doc_id", "text")
    patterns = docs.mapInArrow(toxicity._counted(voters), "voters array<int>, n long")
    got = {(r["i"], r["j"], r["k"]): r["n"] for r in patterns.mapInArrow(toxicity._moments, "i int, j int, k int, n long").groupBy("i", "j", "k").agg(F.sum("n").alias("n")).collect()}
    m = plain.shape[1]
    want = {(i, j, k): int((plain[:, i] & plain[:, j] & plain[:, k]).sum()) for i in range(m) for j in range(i, m) for k in range(j, m)}
    assert got == {k: n for k, n in want.items() if n} | {(-1, -1, -1): len(texts)}
    block = toxicity.Block(np.array([0, 2, 5]), 0.1, np.array([0.7, 0.5, 0.9]), np.array([0.05, 0.1, 0.01]), np.ones(3), 1000)
    for row, q in zip(plain, block.posterior(plain), strict=True):
        both = [share * math.prod(p if row[j] else 1 - p for j, p in zip((0, 2, 5), rates, strict=True)) for share, rates in ((0.1, (0.7, 0.5, 0.9)), (0.9, (0.05, 0.1, 0.01)))]
        assert q == pytest.approx(both[0] / sum(both))


def test_label_model_recovers_planted_accuracies():
    rng = np.random.default_rng(1)
    total, share, on, off = 200_000, 0.08, np.array([0.8, 0.6, 0.5, 0.7, 0.4]), np.array([0.01, 0.02, 0.005, 0.03, 0.01])
    toxic = rng.random(total) < share
    found = rng.random((total, 5)) < np.where(toxic[:, None], on, off)
    found = np.concatenate([found, (found[:, :1] & (rng.random((total, 1)) < 0.95))], axis=1)  # the last one follows the first
    x = found.astype(np.int64)
    third = {(i, j, k): int((x[:, i] * x[:, j] * x[:, k]).sum()) for i in range(6) for j in range(i, 6) for k in range(j, 6)}
    model = toxicity.LabelModel(total, x.sum(axis=0), x.T @ x, third)
    assert len(model.blocks) == 1 and (0, 5) in model.correlated
    block = model.blocks[0]
    assert block.share == pytest.approx(share, abs=0.02)
    assert np.abs(block.on_toxic[:5] - on).max() < 0.12 and np.abs(block.on_clean[:5] - off).max() < 0.02
    assert np.mean((model.posterior(found) > 0.5) == toxic) > 0.98


def test_every_mined_word_votes():
    mined = [(f"{a}{i:03}", tv.Words([f"{a}{i:03}"]).hash[0]) for i in range(60) for a in ("zork", "blub")]
    entries, of, count = toxicity.lexicon(mined)
    assert count == len(toxicity.BUILT_IN) + toxicity.MINED
    voter = {w: int(of[np.searchsorted(entries, h)]) for w, h in mined}
    heads = {v: w for w, v in reversed(list(voter.items()))}
    assert all(heads[v][:4] == w[:4] for w, v in voter.items())


def test_toxicity_without_and_with_labels(spark):
    rng = random.Random(0)
    insults, secret = ["idiot", "stupid", "moron", "scum", "loser", "trash"], [f"zork{i}" for i in range(8)]
    rows, labels = [], []
    for d in range(1500):
        text, toxic = words(d, 60, 500), 0
        if d % 12 in (0, 1):
            toxic = 1
            for w in rng.sample(insults if d % 12 == 0 else secret, 4):
                text.insert(rng.randrange(len(text)), w)
        elif rng.random() < 0.02:
            text.append(rng.choice(insults))
        rows.append((d, " ".join(text), "en", "a"))
        labels.append((d, toxic))
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)
    plain = {r["doc_id"]: r["toxic"] for r in toxicity.judge(docs).collect()}
    assert all(plain[d] == 1 for d in truth if d % 12 == 0)
    assert not any(plain[d] for d in truth if not truth[d])
    held = lab.where("doc_id < 1000")
    found = {r["doc_id"]: r["toxic"] for r in toxicity.judge(docs, held).collect()}
    late = [d for d in truth if d >= 1000]
    assert np.mean([found[d] == truth[d] for d in late]) > 0.97
    assert not any(found[d] for d in truth if not truth[d])


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (5, None), (None, 1), (5, 0), (5, 0)], "doc_id long, toxic int")
    out = toxicity.judge(awkward(spark), labels).collect()
    assert len(out) == 9
    assert not any(r["toxic"] for r in out)
    assert toxicity.judge(spark.createDataFrame([], DOCS), labels).count() == 0


# Mixing (5)


def _plain_schedule(weights, slots):
    """Every slot goes to the source, of those whose next block is released, whose next block is due first."""
    total, done, out = sum(map(Fraction, weights.values())), dict.fromkeys(weights, 0), []
    share = {s: Fraction(w) / total for s, w in weights.items()}
    for t in range(slots):
        free = [s for s in sorted(weights) if math.floor(done[s] / share[s]) <= t]
        best = min(free, key=lambda s: (math.ceil((done[s] + 1) / share[s]), s))
        out.append((best, done[best]))
        done[best] += 1
    return out


IRRATIONAL = {f"s{i}": (i + 1) ** -0.7 for i in range(20)}


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1 / 3, "b": 1 / 7, "c": math.pi / 10}, IRRATIONAL])
def test_schedule_against_a_plain_one(weights):
    got = mixing.schedule(mixing.whole_weights(weights), 800)
    assert sorted((t, s, i) for s, slots in got.items() for i, t in enumerate(slots.tolist())) == [(t, s, i) for t, (s, i) in enumerate(_plain_schedule(weights, 800))]


@pytest.mark.parametrize("weights", [{"a": 1 / 3, "b": 1 / 7, "c": 1 - 1 / 3 - 1 / 7}, IRRATIONAL, {"a": 1.0, "b": 1e-6, "c": 2**0.5}])
def test_deviation_is_below_one_block_at_every_slot(weights):
    slots = 1_000_000
    got, total = mixing.schedule(mixing.whole_weights(weights), slots), sum(weights.values())
    assert sorted(np.concatenate(list(got.values())).tolist()) == list(range(slots))
    for s, mine in got.items():
        done = np.cumsum(np.bincount(mine, minlength=slots))
        assert np.abs(done - np.arange(1, slots + 1) * (weights[s] / total)).max() < 1


def test_mix_row_by_row(spark):
    rng = random.Random(1)
    rows = [(d, "x" * rng.randrange(1, 400), "en", "abc"[0 if d % 10 < 7 else 1 if d % 10 < 9 else 2]) for d in range(2000)]
    weights, size = {"a": 0.4, "b": 0.3, "c": 1 / 3}, 2000
    docs = frame(spark, rows)
    out = mixing.mix(docs, weights=weights, block_chars=size).collect()
    hashed = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id", "text", F.lit(mixing.SEED)).alias("h")).collect()}
    block, count = {}, {}
    for s in "abc":
        at = 0
        for d, text, *_ in sorted((r for r in rows if r[3] == s), key=lambda r: hashed[r[0]]):
            block[d] = at // size
            at += len(text)
        count[s] = -(-at // size)
    total = sum(map(Fraction, weights.values()))
    slots = max(math.ceil(count[s] * total / Fraction(weights[s])) for s in weights)
    want = sorted((d, s, i // count[s], block[d], t) for t, (s, i) in enumerate(_plain_schedule(weights, slots)) for d, _, _, own in rows if own == s and block[d] == i % count[s])
    assert sorted(map(tuple, out)) == want
    assert {r["doc_id"] for r in out} == set(range(2000))


def test_no_source_cuts_another(spark):
    rows = [(d, "x" * 10, "en", "large") for d in range(10_000)] + [(10_000, "y" * 10, "en", "small")] + [(10_001 + d, "z" * 10, "en", "some") for d in range(40)]
    docs = frame(spark, rows)
    for options in ({}, {"weights": {"large": 0.2, "small": 0.4, "some": 0.4}}, {"weights": {"large": 0.2, "small": 0.4, "some": 0.4}, "max_epochs": 4}):
        out = mixing.mix(docs, block_chars=10, **options).collect()
        assert {r["doc_id"] for r in out} == set(range(10_041))
        assert len({r["slot"] for r in out}) == len(out) == len({(r["doc_id"], r["epoch"]) for r in out})
        most = max(r["epoch"] for r in out if r["source"] == "small")
        assert most == 3 if "max_epochs" in options else most > 10


def test_a_million_blocks_beside_one():
    blocks = {"large": 1_000_000, "one": 1}
    weights = mixing.whole_weights({s: n**mixing.TEMPERATURE for s, n in blocks.items()})
    slots = mixing.slots_needed(blocks, weights)
    got = mixing.schedule(weights, slots)
    assert all(len(got[s]) >= n for s, n in blocks.items())
    assert slots < 1_000_200


def test_interleave_keeps_columns_and_order(spark):
    docs = frame(spark, [(d, "y" * 50, "en", "ab"[d % 2]) for d in range(100)], clashing=True).withColumn("a.b", F.lit(1)).withColumn("__mix_slot", F.lit(2)).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    out = mixing.interleave(docs, weights={"a": 1.0, "b": 1.0}, block_chars=100)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(100))
    slot = {r["doc_id"]: r["slot"] for r in mixing.mix(docs, weights={"a": 1.0, "b": 1.0}, block_chars=100).collect()}
    assert [slot[r["doc_id"]] for r in out.collect()] == sorted(slot.values())


def test_mixing_awkward(spark):
    out = mixing.mix(awkward(spark), block_chars=10_000).collect()
    assert {r["doc_id"] for r in out} == {None, 1, 2, 3, 4, 5, 6, 7, 8}
    assert {r["source"] for r in out} == {"", "a", "b", "c"}
    assert sum(r["doc_id"] == 5 and r["epoch"] == 0 for r in out) == 2
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mix(awkward(spark), weights={"zz": 1.0}).count() == 0
    assert {r["source"] for r in mixing.mix(awkward(spark), weights={"zz": 1.0, "b": 2.0}).collect()} == {"b"}
    assert mixing.interleave(spark.createDataFrame([], DOCS)).count() == 0
    for wrong in (-1.0, math.inf, math.nan):
        with pytest.raises(ValueError, match="weights"):
            mixing.mix(awkward(spark), weights={"a": wrong})


# Language ID (6)


def _language(seed, syllables, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_on_held_out_documents(spark):
    tongues = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "ein", "ung", "ber", "tz"], "cc": ["eau", "ique", "ou", "lle", "es"]}
    rows = [(i, _language(i, tongues[g], 40), g if i % 4 else None, "a") for i, g in enumerate(sorted(tongues) * 60)]
    truth = [g for _, g in zip(rows, sorted(tongues) * 60, strict=True)]
    out = {r["doc_id"]: r["language"] for r in langid.identify(frame(spark, rows)).collect()}
    assert np.mean([out[i] == g for i, g in enumerate(truth)]) > 0.98


def _plain_language(model_docs, text):
    """(score by language, words with evidence): counts in dictionaries."""
    cut = lambda t: "".join(c.lower() if c.isalnum() or c == "_" else " " for c in t).split()
    grams = lambda w, n: [(w[i : i + n], i == 0, i + n == len(w)) for i in range(len(w) - n + 1)]
    languages = sorted({g for _, g in model_docs})
    tables = [{} for _ in range(langid.LONGEST + 1)]
    for t, g in model_docs:
        for w in cut(t):
            for n in range(langid.LONGEST + 1):
                for key in [w] if n == 0 else grams(w, n):
                    tables[n].setdefault(key, dict.fromkeys(languages, 0))[g] += 1
    sums = [{g: sum(c[g] for c in table.values()) + 0.1 * len(table) for g in languages} for table in tables]
    log = lambda n, key, g: math.log((tables[n][key][g] + 0.1) / sums[n][g])
    score, evidence = dict.fromkeys(languages, 0.0), 0
    for w in cut(text):
        known = [(0, [w])] if w in tables[0] else []
        known += [(n, [k for k in grams(w, n) if k in tables[n]]) for n in range(langid.LONGEST, 0, -1)]
        n, keys = next(((n, keys) for n, keys in known if keys), (0, []))
        evidence += bool(keys)
        for g in languages if keys else ():
            score[g] += sum(log(n, k, g) for k in keys) / len(keys)
    return score, evidence


def test_language_against_a_plain_scorer(spark):
    tongues = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ein", "ka"], "cc": ["eau", "ou", "mi"]}
    rows = [(i, _language(i, tongues[g], 12), g, "a") for i, g in enumerate(sorted(tongues) * 15)]
    fitted = [(t, g) for _, t, g, _ in rows]
    rows += [(100 + i, _language(900 + i, tongues[g] + ["xyz", "qu"], 9), None, "a") for i, g in enumerate(sorted(tongues) * 15)] + [(200, "漢字 !!", None, "a"), (201, "zz ka", None, "a")]
    for r in langid.identify(frame(spark, rows)).collect():
        score, evidence = _plain_language(fitted, dict((d, t) for d, t, *_ in rows)[r["doc_id"]])
        best = sorted(score.values(), reverse=True)
        assert r["scored_words"] == evidence
        assert r["lead"] == pytest.approx(best[0] - best[1], abs=1e-3)
        if abs(best[0] - best[1] - langid.MIN_LEAD) > 1e-3:
            assert r["language"] == (max(sorted(score), key=score.get) if evidence and best[0] - best[1] >= langid.MIN_LEAD else "und")


def test_language_awkward(spark):
    docs = awkward(spark)
    out = {r["doc_id"]: r["language"] for r in langid.identify(docs).collect()}
    assert out[1] == out[2] == out[7] == "und"
    assert set(out) == {1, 2, 3, 4, 5, 6, 7, 8}
    docs = docs.withColumn("a.b", F.lit(1)).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    kept = langid.keep_determined(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"]: r["lang"] for r in kept.collect() if r["doc_id"]} == {d: g for d, g in out.items() if g != "und"}
    empty = spark.createDataFrame([], DOCS)
    assert langid.identify(empty).count() == 0
    assert {r["language"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# n-gram Jaccard join (7)


def _classes(texts, n, threshold):
    """{doc_id: (class_id, links)} by comparing all with all."""
    sets = {d: _shingles(t, n) for d, t in texts.items()}
    links = {a: {b for b in texts if b != a and (texts[a] == texts[b] or sets[a] and sets[b] and len(sets[a] & sets[b]) >= (threshold - 1e-12) * len(sets[a] | sets[b]))} for a in texts}
    label = {}
    for d in sorted(texts):
        open_ = [d] if d not in label else []
        while open_:
            x = open_.pop()
            if x not in label:
                label[x] = d
                open_ += links[x]
    return {d: (label[d], len(links[d])) for d in texts}


@pytest.mark.parametrize(("n", "threshold", "split"), [(3, 0.6, False), (3, 0.6, True), (1, 0.8, True)])
def test_near_classes_against_brute_force(spark, monkeypatch, n, threshold, split):
    if split:  # small tables take the ways of large groups
        for name, value in (("HOT_GROUP", 8), ("BLOCK_DOCS", 6), ("LIST_ROWS", 10), ("CELL_PAIRS", 12), ("HELD_PAIRS", 50), ("HOT_DF", 4)):
            monkeypatch.setattr(jaccard, name, value)
    texts, passage = {}, words(9, 60)
    for d in range(240):
        base = words(d // 6, 30 + d // 6 * 3)
        texts[d] = " ".join(edited(base, (d % 6) * 3, d) + (passage if d % 4 == 0 else []))
    texts |= {500 + d: " ".join(edited(words(77, 80), d % 14, 4000 + d)) for d in range(60)}
    texts |= {1000 + d: texts[d] for d in [*range(0, 240, 40), *range(500, 504)]}
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.near_classes(frame(spark, [(d, t, "en", "a") for d, t in texts.items()]), n, threshold).collect()}
    assert got == _classes(texts, n, threshold)
    assert max(links for _, links in got.values()) > 20


def test_hot_groups_leave_the_lists(spark, monkeypatch):
    texts = {d: " ".join(edited(words(5, 100), d % 5, d)) for d in range(80)}
    docs = frame(spark, [(d, t, "en", "a") for d, t in texts.items()]).select("doc_id", "text")
    monkeypatch.setattr(jaccard, "HOT_GROUP", 8)
    signs, value, size = jaccard._buckets(docs, 3)
    assert len(value) and size.min() >= 8
    times = docs.where("false").select("doc_id", F.lit(1).alias("times"))
    send = spark.sparkContext.broadcast
    often = jaccard._hot(docs, 3)
    listed = [jaccard._candidate_links(docs, times, send((often, v)), 3, 0.6).agg(F.sum("links")).first()[0] or 0 for v in (value[:0], value)]
    assert listed[1] < 0.2 * listed[0]
    compared = jaccard._hot_links(docs, times, signs, send((value, size)), 3, 0.6).agg(F.sum("links")).first()[0]
    assert compared + listed[1] == listed[0]


def test_groups_and_drop(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 9), (9, 7), (10, 11), (11, 12), (12, 13), (13, 14)], "doc_id_a long, doc_id_b long")
    assert {r["doc_id"]: r["group"] for r in jaccard.groups(pairs).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 9: 5, 7: 5, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}
    docs = awkward(spark)
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, 4, 5, 7, 8, None, None]


def test_jaccard_awkward(spark):
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.near_classes(awkward(spark)).collect()}
    assert got == {d: (d, 0) for d in (1, 2, 3, 4, 7, 8)} | {5: (5, 1), 6: (5, 1)}
    assert jaccard.near_classes(spark.createDataFrame([], DOCS)).count() == 0
    assert jaccard.drop_near_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_one_text_of_a_doc_id_counts(spark):
    one, two = " ".join(words(1, 40)), " ".join(words(2, 40))
    docs = frame(spark, [(1, one, "en", "a"), (1, two, "en", "a"), (2, one, "en", "a"), (3, two, "en", "a")])
    least = min((one, two), key=lambda t: hashlib.md5(t.encode()).digest())
    other = 2 if least == one else 3
    got = {r["doc_id"]: r["class_id"] for r in jaccard.near_classes(docs).collect()}
    assert got == {1: 1, other: 1, 5 - other: 5 - other}
    odd = docs.withColumn("a.b", F.lit(1)).withColumn("m", F.create_map(F.lit(1), F.lit("x"))).withColumn("__own_id", F.lit(7)).withColumn("Lead", F.lit(7))
    kept = jaccard.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5 - other]


# Token counts (8)


def _by_hand(text, rule, starts=None):
    enc = bpe.encoding()
    sections, at = [], 0
    cuts = [0, *(x for x in starts if 0 < x < len(text)), len(text)] if starts is not None else []
    for line in [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] or text.splitlines(keepends=True) or [""]:
        sections.append((at, at + len(line)))
        at += len(line)
    out = [0.0] * len(sections)
    raw, byte = text.encode(), 0
    char_of = [len(raw[:i].decode("utf-8", "ignore")) for i in range(len(raw) + 1)] if len(raw) < 3000 else None
    for t in enc.encode_ordinary(text):
        size = len(enc.decode_single_token_bytes(t))
        a = char_of[byte]
        b = next(i for i in range(len(text) + 1) if len(text[:i].encode()) >= byte + size)
        byte += size
        held = [max(0, min(b, e) - max(a, s)) for s, e in sections]
        if rule == "start":
            out[next(i for i, (s, e) in enumerate(sections) if s <= a < e)] += 1
        elif rule == "majority":
            out[held.index(max(held))] += 1
        else:
            for i, h in enumerate(held):
                out[i] += h / (b - a)
    return out


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_section_tokens_against_counting_by_hand(spark, rule):
    texts = ["one line", "two\nlines here\n", "\n\n\nblank   \n\n  lines", "é ü ñ 漢字 🙂🙂\nnext 漢", "a\n\n\n\n\nb", "tail\n\n", "x \n y \n z"]
    out = tokencount.section_tokens(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), rule).orderBy("doc_id", "section").collect()
    for i, t in enumerate(texts):
        mine = [r for r in out if r["doc_id"] == i]
        assert [r["tokens"] for r in mine] == pytest.approx(_by_hand(t, rule)), t
        assert sum(r["chars"] for r in mine) == len(t)
        assert sum(r["tokens"] for r in mine) == pytest.approx(len(bpe.encoding().encode_ordinary(t)))


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_given_sections_against_counting_by_hand(spark, rule):
    rows = [(0, "title of it body of the text", [9, 3, 3, None, 99, -1, 0]), (1, "é ü ñ 漢字 🙂🙂 next", [1, 2, 3, 6, 7, 8, 9, 10]), (2, "no starts at all", None), (3, "", [0, 1]), (4, None, [0]), (5, "aaaaaaaaaaaaaaaaaaaaaaaa", [5, 6, 7])]
    out = tokencount.section_tokens(spark.createDataFrame(rows, "doc_id long, text string, `a.b` array<long>"), rule, starts="a.b").orderBy("doc_id", "section").collect()
    for i, t, own in rows:
        mine = [r for r in out if r["doc_id"] == i]
        assert [r["tokens"] for r in mine] == pytest.approx(_by_hand(t or "", rule, sorted({x for x in own or [] if x is not None}))), t
        assert sum(r["chars"] for r in mine) == len(t or "")


def test_section_tokens_awkward(spark):
    out = tokencount.section_tokens(awkward(spark)).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 3, 4, 5, 6, 7, 8}
    assert all(r["tokens"] == 0 for r in out if r["doc_id"] in (1, 2))
    assert tokencount.section_tokens(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="rule"):
        tokencount.section_tokens(awkward(spark), "nearest")


def test_words_of_a_batch():
    w = tv.Words(["Ab c", None, "", "été x_1"])
    assert [w.text(a, b) for a, b in zip(w.start, w.end, strict=True)] == ["ab", "c", "été", "x_1"]
    assert w.first.tolist() == [0, 2, 2, 2, 4]
    assert tv.Words(["c"]).hash[0] == w.hash[1]
