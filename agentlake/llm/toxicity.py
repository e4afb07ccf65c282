"""Operator 4: toxicity by weak supervision.

Voters are small lexicons and patterns that vote 'toxic' or abstain.  Besides
those given here, words and beginnings of words (PREFIX characters; they count where two
words have them) that are much more frequent in documents labelled toxic become voters (found in about LABELLED_DOCS
labelled documents, picked by a hash): the MINED strongest each for itself, every other
one as a further entry of the one that it resembles most (longest common beginning).
How far to believe any voter is not taken from labels.

A generative label model estimates it from the votes over all documents: votes
are correlated because they share a hidden class.  Voters fall into blocks that
vote together (a language's insults, say), each with a class of its own; within a
block, covariances are a rank-one part (the accuracies) and a sparse rest (voters
that depend on each other beyond the class), and third moments give the share of
the class.  Voters that depend on others count less.  A mined voter that belongs to no
block is believed as much as those in blocks are on average.  From there, EM_ROUNDS
rounds of expectation maximisation over all vote patterns sharpen the estimates.
A document is toxic if it is so in any block.  That posterior labels documents for a
linear classifier over words and their beginnings (logistic regression), which judges
all documents.

All moments are exact counts over the whole corpus, summed from vote patterns by
a distributed aggregation whose size does not depend on it.  The classifier is
fitted on about FIT_DOCS documents, picked by a hash.  Votes, moments and scores
are numpy over whole batches; texts are never shuffled.

Defined results: null and empty texts have no votes and the classifier's bias
alone, so they are not toxic; rows without doc_id are left out; repeated rows
are judged each; other columns do not matter; a corpus in which fewer than three
voters ever vote has no label model, and nothing is toxic; an empty table gives
no rows.
"""

from __future__ import annotations

import copy
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import identified, settle, small

FIT_DOCS, LABELLED_DOCS, MINED, FEATURES, LEAST_VOTES, EM_ROUNDS, DECISION = 12_000, 20_000, 80, 1 << 18, 5, 5, 0.5
#: Characters of a word's beginning; least log ratio of frequencies of an entry, and log likelihood ratio against chance (10.5: some 3 in 100,000).
PREFIX, LEAST_LIFT, LEAST_SURE = 5, 2.0, 10.5
_BEGINNING = np.uint64(0x6A09E667F3BCC909)

LEXICONS: list[str] = [
    "idiot idiots idiotic idiote idioten idiota idiotas", "moron morons moronic", "stupid stupidity stupide stupides dumm dumme dummkopf estúpido estúpida estúpidos",
    "pathetic pathétique erbärmlich patético patética", "loser losers verlierer perdedor perdedora perdant", "scum scumbag scumbags abschaum escoria racaille", "worthless inutile wertlos inútil",
    "clown clowns bouffon payaso payasos", "trash garbage ordure ordures müll basura", "disgusting dégoûtant dégoûtante ekelhaft widerlich asqueroso asquerosa",
    "dumb dumbass dumber", "fool fools foolish imbécile imbéciles imbécil trottel", "jerk jerks", "creep creeps creepy", "freak freaks", "ugly moche hässlich feo fea",
    "vermin parasite parasites ungeziefer alimañas", "pig pigs swine schwein schweine cerdo cerdos porc", "coward cowards lâche feigling cobarde", "liar liars menteur lügner mentiroso",
    "hate hated hateful haine hass odio", "damn damned bloody verdammt maldito maldita putain", "crap crappy shit shitty bullshit merde scheiße mierda", "fuck fucking fucked fucker motherfucker",
    "bastard bastards bâtard bastardo arschloch asshole assholes connard cabrón", "bitch bitches whore salope hure puta", "retard retarded spast subnormal", "nazi nazis fascist fascists",
    "kill killed murder tuer töten matar", "dead crève verrecke muérete",
]
PHRASES = ["shut up", "go to hell", "kill yourself", "hate you", "you are a", "you idiot", "ta gueule", "halt die fresse", "vete al infierno", "drop dead"]
BUILT_IN = [*(f"lexicon {x.split()[0]}" for x in LEXICONS), "phrases", "capitals", "exclamations"]


def _hash(text: str) -> np.ndarray:
    return tv.Words([text]).hash


def beginnings(words: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words longer than PREFIX, hashes of their beginnings)."""
    long = np.flatnonzero(words.end - words.start > PREFIX)
    return long, words.span_hash(words.start[long], words.start[long] + PREFIX) ^ _BEGINNING


def lexicon(mined: list[tuple[str, np.uint64]] | tuple = ()) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted hashes, voter of each, number of voters); mined: (text, hash), the strongest first."""
    listed = [_hash(x) for x in LEXICONS]
    known = np.concatenate(listed)
    heads: list[str] = []
    voter = []
    mined = [(text, h) for text, h in mined if h not in known]
    for text, _ in mined:
        if len(heads) < MINED:
            heads.append(text)
            voter.append(len(heads) - 1)
        else:
            voter.append(max(range(len(heads)), key=lambda i: (len(os.path.commonprefix([heads[i], text])), -i)))
    entry = np.concatenate([known, np.array([h for _, h in mined], np.uint64)])
    of = np.concatenate([np.repeat(np.arange(len(listed)), [len(x) for x in listed]), len(BUILT_IN) + np.array(voter, np.int64)])
    entry, first = np.unique(entry, return_index=True)
    return entry, of[first], len(BUILT_IN) + len(heads)


def votes(words: tv.Words, lexicon: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Which voter (column) votes for which document (row)."""
    docs = len(words.first) - 1
    out = np.zeros((docs, lexicon[2]), bool)
    total = np.diff(words.first)
    if not len(words.hash):
        return out
    doc = words.doc_of_word()
    long, begin = beginnings(words)
    for number, h, least in ((np.arange(len(doc)), words.hash, 1), (long, begin, 2)):
        at = np.searchsorted(lexicon[0], h)
        at[at == len(lexicon[0])] = 0
        hit = np.flatnonzero(lexicon[0][at] == h)
        pair, count = np.unique(doc[number[hit]] * len(lexicon[0]) + at[hit], return_counts=True)
        pair = pair[count >= least]
        out[pair // len(lexicon[0]), lexicon[1][pair % len(lexicon[0])]] = True
    many = len(LEXICONS)
    for phrase in PHRASES:
        h = _hash(phrase)
        place = np.flatnonzero(words.hash == h[0])
        for k in range(1, len(h)):
            place = place[place + k < len(words.hash)]
            place = place[(words.hash[place + k] == h[k]) & (doc[place + k] == doc[place])]
        out[doc[place], many] = True
    capital = np.concatenate([[0], np.cumsum(words.capital)])[words.base]
    mark = np.concatenate([[0], np.cumsum(words.codes == ord("!"))])[words.base]
    out[:, many + 1] = np.diff(capital) > 0.4 * np.maximum(np.diff(words.base) - 1, 1)
    out[:, many + 2] = np.diff(mark) > 0.1 * np.maximum(total, 1)
    return out


def _words_by_label() -> Callable:
    """In how many toxic and other documents each word and beginning occurs, of a labelled part; one row for the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices(batch):
                words = tv.Words(part.column("text").to_pylist())
                label = part.column("toxic").to_numpy(zero_copy_only=False) > 0
                doc = words.doc_of_word()
                yield pa.RecordBatch.from_pydict({"kind": pa.array([0], pa.int32()), "word": pa.array([0], pa.int64()), "text": pa.array([""]), "toxic": pa.array([int(label.sum())]), "all": pa.array([len(label)])})
                long, begin = beginnings(words)
                for kind, number, h in ((1, np.arange(len(doc)), words.hash), (2, long, begin)):
                    order = np.lexsort((h, doc[number]))
                    new = np.ones(len(h), bool)
                    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[number[order]][1:] != doc[number[order]][:-1])
                    at = np.flatnonzero(new)
                    at = order[at[np.diff(np.append(at, len(h))) >= kind]]
                    word, first, back = np.unique(h[at], return_index=True, return_inverse=True)
                    example = number[at[first]]
                    end = words.end[example] if kind == 1 else words.start[example] + PREFIX
                    text = [words.text(a, b) for a, b in zip(words.start[example].tolist(), end.tolist(), strict=True)]
                    toxic = np.bincount(back, label[doc[number[at]]], minlength=len(word)).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"kind": np.full(len(word), kind, np.int32), "word": tv.signed(word), "text": pa.array(text, pa.string()), "toxic": toxic, "all": np.bincount(back, minlength=len(word)).astype(np.int64)})

    return run


def mine(docs: DataFrame, labels: DataFrame, labelled_docs: int = LABELLED_DOCS) -> list[tuple[str, np.uint64]]:
    """(text, hash) of the words and beginnings tied to the label 'toxic' (labels: doc_id, toxic), the strongest first.

    A beginning becomes one if it is in 1.3 times as many toxic documents as any single word with it.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rate = int(min(1.0, labelled_docs / max(own.count(), 1)) * (1 << 30))
    chosen = settle(own.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < rate))
    counts = docs.join(small(chosen), "doc_id").mapInArrow(_words_by_label(), "kind int, word long, text string, toxic long, all long").groupBy("kind", "word").agg(F.min("text").alias("text"), F.sum("toxic").alias("toxic"), F.sum("all").alias("all"))
    counts = settle(counts)
    whole = counts.where("kind = 0").first()
    if whole is None or not whole["toxic"] or whole["toxic"] == whole["all"]:
        return []
    lift = F.expr(f"ln((toxic + 0.5D) / {whole['toxic']}D) - ln((`all` - toxic + 0.5D) / {whole['all'] - whole['toxic']}D)")
    share = whole["toxic"] / whole["all"]
    sure = F.expr(f"toxic * ln(toxic / (`all` * {share}D)) + if(toxic < `all`, (`all` - toxic) * ln((`all` - toxic) / (`all` * {1 - share}D)), 0D)")
    found = counts.where("kind > 0 AND toxic > 0").withColumn("lift", lift).where((F.col("lift") > LEAST_LIFT) & (sure >= LEAST_SURE)).orderBy(F.desc(F.expr("toxic * lift")), "word").collect()
    most: dict[str, int] = {}
    for r in found:
        if r["kind"] == 1 and len(r["text"]) > PREFIX:
            most[r["text"][:PREFIX]] = max(most.get(r["text"][:PREFIX], 0), r["toxic"])
    return [(r["text"], np.int64(r["word"]).view(np.uint64)) for r in found if r["kind"] == 1 or r["toxic"] >= 1.3 * most.get(r["text"], 0)]


def _patterns(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each occurs."""
    if not len(found):
        return found, np.zeros(0, np.int64)
    packed = np.packbits(found, axis=1)
    _, first, count = np.unique(packed.view(f"V{packed.shape[1]}").ravel(), return_index=True, return_counts=True)
    return found[first], count


def _counted(lexicon: tuple[np.ndarray, np.ndarray, int]) -> Callable:
    """Vote patterns (voters that vote, rising) and how many documents have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, ...], int] = {}
        for batch in batches:
            for part in tv.slices(batch):
                rows, count = _patterns(votes(tv.Words(part.column("text").to_pylist()), lexicon))
                for row, c in zip(rows, count.tolist(), strict=True):
                    key = tuple(np.flatnonzero(row).tolist())
                    seen[key] = seen.get(key, 0) + c
        yield pa.RecordBatch.from_pydict({"voters": pa.array([list(k) for k in seen], pa.list_(pa.int32())), "n": pa.array(list(seen.values()), pa.int64())})

    return run


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of documents by every voter, pair and triple (i <= j <= k) that votes in them; of all at -1."""
    sums: dict[tuple[int, int, int], int] = {}
    for batch in batches:
        for on, c in zip(batch.column("voters").to_pylist(), batch.column("n").to_pylist(), strict=True):
            sums[-1, -1, -1] = sums.get((-1, -1, -1), 0) + c
            for x, i in enumerate(on):
                for y in range(x, len(on)):
                    for k in on[y:]:
                        sums[i, on[y], k] = sums.get((i, on[y], k), 0) + c
    keys = list(sums)
    yield pa.RecordBatch.from_pydict({**{c: pa.array([k[n] for k in keys], pa.int32()) for n, c in enumerate("ijk")}, "n": pa.array(list(sums.values()), pa.int64())})


def _expectation(model: LabelModel, voters: int) -> Callable:
    """Expected numbers of toxic documents by block (voter -1) and by voter in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(model.blocks), voters + 1))
        for batch in batches:
            rows, n = batch.column("voters").to_pylist(), batch.column("n").to_numpy()
            found = np.zeros((len(rows), voters), bool)
            for i, on in enumerate(rows):
                found[i, on] = True
            for b, block in enumerate(model.blocks):
                q = block.posterior(found) * n
                sums[b, :voters] += q @ found
                sums[b, voters] += q.sum()
        b, j = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"block": b.astype(np.int32), "voter": np.where(j == voters, -1, j).astype(np.int32), "q": sums[b, j]})

    return run


class Block:
    """Voters that share a class: its share and how often each votes with and without it."""

    def __init__(self, voters: np.ndarray, share: float, on_toxic: np.ndarray, on_clean: np.ndarray, discount: np.ndarray, total: int):
        self.voters, self.discount, self.total = voters, discount, total
        self.set(share, on_toxic, on_clean)

    def set(self, share: float, on_toxic: np.ndarray, on_clean: np.ndarray) -> None:
        self.share = float(np.clip(share, 1e-6, 0.5))
        floor = 0.5 / self.total
        on_toxic, on_clean = np.clip(on_toxic, floor, 1 - 1e-3), np.clip(on_clean, floor, 1 - 1e-3)
        self.on_toxic, self.on_clean = on_toxic, on_clean
        yes, no = np.log(on_toxic / on_clean), np.log((1 - on_toxic) / (1 - on_clean))
        self.weight = self.discount * (yes - no)
        self.bias = float(np.log(self.share / (1 - self.share)) + (self.discount * no).sum())

    def posterior(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + found[:, self.voters] @ self.weight, -50, 50)))


class LabelModel:
    """Accuracies, correlations and class shares from the moments of the votes."""

    def __init__(self, total: int, first: np.ndarray, second: np.ndarray, third: dict[tuple[int, int, int], int]):
        self.correlated: list[tuple[int, int]] = []
        self.blocks: list[Block] = []
        active = np.flatnonzero((first >= LEAST_VOTES) & (first < total))
        if len(active) < 3:
            return
        p = first / max(total, 1)
        scale = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        corr = (second / total - np.outer(p, p)) / np.outer(scale, scale)
        for block in _blocks(active, corr):
            self._fit(block, total, p, scale, corr, second, third)

    def _fit(self, a: np.ndarray, total: int, p: np.ndarray, scale: np.ndarray, corr: np.ndarray, second: np.ndarray, third: dict) -> None:
        c, p, scale = corr[np.ix_(a, a)], p[a], scale[a]
        off = ~np.eye(len(a), dtype=bool)
        used = off.copy()
        u = _by_triples(c)
        for _ in range(3):
            rest = np.abs(c - np.outer(u, u))
            dependent = off & (rest > max(0.2, 6 * np.median(rest[used]) if used.any() else 0.0))
            if (used & ~dependent).sum(axis=1).min() < 2:
                break  # too few pairs would be left to tell a voter's accuracy
            used &= ~dependent
            for _ in range(200):  # the rank-one part, over the pairs in use
                u = 0.5 * u + 0.5 * (np.where(used, c, 0) @ u) / np.maximum((used * u**2).sum(axis=1), 1e-6)
                u = np.clip(u, -0.99, 0.99)
        u = -u if u.sum() < 0 else u
        self.correlated += [(int(a[x]), int(a[y])) for x, y in zip(*np.nonzero(off & ~used), strict=True) if x < y]
        effect = u * scale
        skew, base = [], []
        for x in range(len(a)):
            for y in range(x + 1, len(a)):
                for z in range(y + 1, len(a)):
                    if used[x, y] and used[y, z] and used[x, z]:
                        i, j, k = sorted((int(a[x]), int(a[y]), int(a[z])))
                        skew.append(third.get((i, j, k), 0) / total - (p[x] * second[a[y], a[z]] + p[y] * second[a[x], a[z]] + p[z] * second[a[x], a[y]]) / total + 2 * p[x] * p[y] * p[z])
                        base.append(effect[x] * effect[y] * effect[z])
        ratio = float(np.dot(skew, base) / max(np.dot(base, base), 1e-30)) if base else 0.0
        # ratio = (1 - 2 share) / sqrt(share (1 - share)), of which this is the smaller root.
        share = float(np.clip(0.5 * (1 - ratio / np.sqrt(ratio * ratio + 4)), 1e-5, 0.5))
        gap = effect / np.sqrt(share * (1 - share))
        discount = 1 / (1 + (np.where(off & ~used, np.abs(c), 0)).sum(axis=1))
        self.blocks.append(Block(a, share, p + (1 - share) * gap, p - share * gap, discount, total))

    def add_lone(self, total: int, first: np.ndarray) -> None:
        """Mined voters that no block holds are believed as much as lexicons and mined ones in blocks are on average."""
        weight, sure, held = 0.0, 0.0, set()
        for block in self.blocks:
            held |= set(block.voters.tolist())
            words = (block.voters < len(LEXICONS)) | (block.voters >= len(BUILT_IN))
            voted, missed = block.share * block.on_toxic, (1 - block.share) * block.on_clean
            count = first[block.voters] * words
            weight, sure = weight + count.sum(), sure + (count * voted / (voted + missed)).sum()
        for j in range(len(BUILT_IN), len(first)) if weight else ():
            if j not in held and LEAST_VOTES <= first[j] < total:
                p, precision = first[j] / total, min(sure / weight, 0.99)
                share = min(p * precision, 0.5)
                self.blocks.append(Block(np.array([j]), share, np.ones(1), np.array([p * (1 - precision) / (1 - share)]), np.ones(1), total))

    def posterior(self, found: np.ndarray) -> np.ndarray:
        clean = np.ones(len(found))
        for block in self.blocks:
            clean *= 1 - block.posterior(found)
        return 1 - clean


def _by_triples(c: np.ndarray, least: float = 0.02) -> np.ndarray:
    """First estimate of each voter's part in the class: the median over pairs of others, which a few dependent voters do not move."""
    u = np.full(len(c), 0.3)
    for i in range(len(c)):
        others = np.delete(np.arange(len(c)), i)
        among = c[np.ix_(others, others)]
        x, y = np.nonzero(np.triu(among > least, 1))
        if len(x):
            u[i] = np.sqrt(np.clip(np.median(c[i, others[x]] * c[i, others[y]] / among[x, y]), 0, 0.98))
    return u


def _blocks(active: np.ndarray, corr: np.ndarray, least: float = 0.1) -> list[np.ndarray]:
    """Groups of three voters or more that correlation connects."""
    left, out = set(active.tolist()), []
    while left:
        block, edge = set(), [min(left)]
        while edge:
            i = edge.pop()
            if i in left:
                left.discard(i)
                block.add(i)
                edge += [j for j in left if corr[i, j] > least]
        if len(block) > 2:
            out.append(np.array(sorted(block)))
    return out


def label_model(docs: DataFrame, lexicon: tuple[np.ndarray, np.ndarray, int], rounds: int = EM_ROUNDS) -> LabelModel:
    """Fitted on the votes over all documents."""
    patterns = settle(docs.mapInArrow(_counted(lexicon), "voters array<int>, n long").groupBy("voters").agg(F.sum("n").alias("n")))
    rows = patterns.mapInArrow(_moments, "i int, j int, k int, n long").groupBy("i", "j", "k").agg(F.sum("n").alias("n")).collect()
    third = {(r["i"], r["j"], r["k"]): r["n"] for r in rows}
    m = lexicon[2]
    first = np.array([third.get((i, i, i), 0) for i in range(m)])
    second = np.array([[third.get((min(i, j), max(i, j), max(i, j)), 0) for j in range(m)] for i in range(m)])
    total = third.get((-1, -1, -1), 0)
    model = LabelModel(total, first, second, third)
    for _ in range(rounds if model.blocks else 0):
        sums = {(r["block"], r["voter"]): r["q"] for r in patterns.mapInArrow(_expectation(model, m), "block int, voter int, q double").groupBy("block", "voter").agg(F.sum("q").alias("q")).collect()}
        for b, block in enumerate(model.blocks):
            toxic = sums.get((b, -1), 0.0)
            voted = np.array([sums.get((b, int(j)), 0.0) for j in block.voters])
            block.set(toxic / total, (voted + 0.1) / (toxic + 1), (first[block.voters] - voted + 0.1) / (total - toxic + 1))
    model.add_lone(total, first)
    return model


def _features(words: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each document's distinct words and beginnings."""
    long, begin = beginnings(words)
    doc = words.doc_of_word()
    both = copy.copy(words)
    order = np.argsort(np.concatenate([doc, doc[long]]), kind="stable")
    both.hash = np.concatenate([words.hash, begin])[order]
    both.first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(words.first) - 1) + np.bincount(doc[long], minlength=len(words.first) - 1))])
    value, first = tv.shingles(both, 1)
    return (value % np.uint64(FEATURES)).astype(np.int32), first


def _examples(sent: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = sent.value
        for batch in batches:
            for part in tv.slices(batch):
                words = tv.Words(part.column("text").to_pylist())
                bucket, first = _features(words)
                yield pa.RecordBatch.from_pydict({"buckets": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(bucket, pa.int32())), "y": model.posterior(votes(words, lexicon))})

    return run


def train(buckets: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 150, decay: float = 2e-4, least: int = 3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels: (weight of each bucket, bias); Adam over all examples."""
    n = len(y)
    seen = np.bincount(buckets, minlength=FEATURES)
    doc = np.repeat(np.arange(n), np.diff(first))
    keep = seen[buckets] >= least
    buckets, doc = buckets[keep], doc[keep]
    weight, bias = np.zeros(FEATURES), float(np.log(max(y.mean(), 1e-4) / max(1 - y.mean(), 1e-4)))
    m, v, mb, vb = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = bias + np.bincount(doc, weight[buckets], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g, gb = np.bincount(buckets, error[doc], minlength=FEATURES) + decay * weight, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        weight -= 0.05 * (m / a) / (np.sqrt(v / b) + 1e-6)
        bias -= 0.05 * (mb / a) / (np.sqrt(vb / b) + 1e-6)
    return weight, float(bias)


def _judge(fitted: object, decision: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model, weight, bias = fitted.value
        for batch in batches:
            for part in tv.slices(batch):
                words = tv.Words(part.column("text").to_pylist())
                bucket, first = _features(words)
                total = np.concatenate([[0.0], np.cumsum(weight[bucket], dtype=np.float64)])
                score = 1 / (1 + np.exp(-np.clip(bias + np.diff(total[first]), -30, 30)))
                found = votes(words, lexicon)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "votes": found.sum(axis=1).astype(np.int32), "posterior": model.posterior(found), "score": score, "toxic": (score >= decision).astype(np.int32)})

    return run


def judge(docs: DataFrame, labels: DataFrame | None = None, fit_docs: int = FIT_DOCS, decision: float = DECISION) -> DataFrame:
    """(doc_id, votes, posterior, score, toxic) of every document; labels (doc_id, toxic) add voters."""
    context = docs.sparkSession.sparkContext
    own = identified(docs, "text")
    voters = lexicon(mine(own, labels) if labels is not None else ())
    model = label_model(own, voters)
    rate = int(min(1.0, fit_docs / max(own.count(), 1)) * (1 << 30))
    sent = context.broadcast((voters, model))
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate).mapInArrow(_examples(sent), "buckets array<int>, y double").toArrow().combine_chunks()
    y = chosen.column("y").to_numpy()
    lists = chosen.column("buckets").combine_chunks()
    weight, bias = np.zeros(FEATURES), -10.0
    if len(y):
        first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        weight, bias = train(lists.flatten().to_numpy(), first, y)
    fitted = context.broadcast((voters, model, weight.astype(np.float32), bias))
    return own.mapInArrow(_judge(fitted, decision), "doc_id long, votes int, posterior double, score double, toxic int")
