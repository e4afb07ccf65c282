"""Operator 9: near copies among embeddings by a robust-pruned flat graph.

1. Equal vectors are collapsed: the lowest vec_id stands for them.
2. Balls.  Two vectors within half the radius (an angle) of a third are within the
   radius of each other, whatever they are.  Crowded places are found in a sample
   (SAMPLE rows, picked by a hash; CROWD of them within half the radius); what lies
   within half the radius of such a centre is linked to all of its ball without a
   comparison, so that a group of any size costs a comparison a row.  Vectors from
   elsewhere that a ball may reach visit it: they are compared with its members
   exactly, block by block.
3. Shards.  Pivots (hash-chosen rows, grouped under about sqrt(pivots) cells) cut the
   rest into shards of about SHARD_ROWS rows; each vector joins the shards of the
   nearest pivots in its two nearest cells, so that shards overlap.  Shards of more
   than MOST_ROWS are drawn on for balls and pivots again.
4. In each shard every vector's candidates (its nearest ones and a few random ones)
   are pruned robustly: a candidate is dropped if a kept one is nearer to it by the
   factor ALPHA than the vector is.  Kept edges count in both directions, the nearest
   DEGREE of them.  Every member is a query: greedy search of beam BEAM from medoids
   and its own place, then range expansion: whatever lies within the radius is
   expanded until nothing new lies within it.
5. The lists of what lies within the radius are united over a vector's shards, and the
   expansion goes on across shards: where two neighbours of a vector share no shard
   they are compared, until nothing new is found.
6. Cosines are computed exactly for whatever is reported, and recall is audited against
   brute force: AUDIT rows outside of the balls, picked by a hash, and twice as many
   until PARTNERED have a partner or BLOCK_ROWS are audited.  It is the mean over rows
   with partners of the share of them that was found.  Below TARGET the next of
   ATTEMPTS follows: more shards for each vector and a wider beam.  If the last one
   fails too, or if the audit has come to all rows, the links are those of an exact
   join, block by block; nothing below TARGET is returned.

The result has one row per vector: its class (what links connect) and its number of
links.  Shuffled are the vectors by shard (about twice), pairs within the radius, and
visitors with the balls' members; what is broadcast are pivots (MOST_PIVOTS and SAMPLE
for each time that shards are too large) and the audited rows.

Defined results: null vectors, ones with a null or non-finite member, zero vectors
and ones not of the most frequent length are linked to nothing; rows without vec_id are
left out; repeated rows count once, and of several vectors of one vec_id the least
counts; other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, small
from .jaccard import _FOUND, _forest, _found, groups

THRESHOLD, SHARD_ROWS, POOL, RANDOM, DEGREE, ALPHA, BEAM, AUDIT, TARGET = 0.9, 1500, 32, 6, 24, 1.2, 12, 1000, 0.95
#: Rows with partners that recall is taken over; (shards of each vector, times the beam); rows compared with all in one scan.
PARTNERED, ATTEMPTS, BLOCK_ROWS = 50, ((2, 1), (3, 2), (6, 4)), 16_384
#: Rows that crowded places are found in, and how many of them make one; pivots and rows of a shard at most; rows of a ball's block.
SAMPLE, CROWD, MOST_PIVOTS, MOST_ROWS, BALL_ROWS = 4096, 5, 16_384, 50_000, 4096
_VECTOR = "vec_id long, embedding array<float>, times long"


def _unit(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x, np.float32).ravel()), x.shape[1]).cast(pa.list_(pa.float32()))


def _drawn(vectors: DataFrame, rows: int, size: int, seed: int) -> np.ndarray:
    """Unit vectors of about ``size`` of the rows, picked by a hash; one at least."""
    whole = 1 << 30
    rate = min(whole, -(-size * whole // max(rows, 1)))
    picked = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(whole)) < rate).orderBy("vec_id").select("embedding").toArrow().combine_chunks()
    if not picked.num_rows:
        picked = vectors.orderBy("vec_id").limit(1).select("embedding").toArrow().combine_chunks()
    return _unit(picked.column("embedding").combine_chunks())


# Balls


def crowded(sample: np.ndarray, half: float, least: int = CROWD) -> np.ndarray:
    """Vectors of the sample with ``least`` of it within the cosine ``half``, none of them within it of another."""
    kept: list[np.ndarray] = []
    near = np.concatenate([(sample[a : a + 512] @ sample.T >= half).sum(axis=1) for a in range(0, len(sample), 512)])
    for i in np.argsort(-near, kind="stable")[: int((near >= least).sum())].tolist():
        if not kept or (np.stack(kept) @ sample[i]).max() < half:
            kept.append(sample[i])
    return np.stack(kept) if kept else np.zeros((0, sample.shape[1]), np.float32)


def _judge(sent: object, half: float, reach: float) -> Callable:
    """Of each vector the nearest centre within half the radius (else -1) and the other balls that it may have links in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                dots = _unit(part.column("embedding")) @ centres.T
                ball = dots.argmax(axis=1)
                ball[dots[np.arange(len(ball)), ball] < half] = -1
                row, visit = np.nonzero(dots >= reach)
                # What is in a ball visits earlier ones only: those of later balls come to it.
                keep = (visit != ball[row]) & ((ball[row] < 0) | (visit < ball[row]))
                count = np.bincount(row[keep], minlength=len(ball))
                visits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(visit[keep].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "embedding", "times")), pa.array(ball.astype(np.int32)), visits], ["vec_id", "embedding", "times", "ball", "visits"])

    return run


def _meet(threshold: float) -> Callable:
    """All pairs of visitors and members in a cell, as _FOUND."""

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        guest = part.column("guest").to_numpy(zero_copy_only=False)
        x, ids, times = _unit(part.column("embedding").combine_chunks()).astype(np.float64), part.column("vec_id").to_numpy(), part.column("times").to_numpy()
        host, links, edges = np.flatnonzero(~guest), np.zeros(len(ids), np.int64), [np.zeros((0, 2), np.int64)]
        for a in range(0, int(guest.sum()) if len(host) else 0, 500):
            rows = np.flatnonzero(guest)[a : a + 500]
            near = x[rows] @ x[host].T >= threshold
            links[rows] += near @ times[host]
            links[host] += times[rows] @ near
            some = np.flatnonzero(near.any(axis=1))  # the members are connected by their ball
            edges.append(np.stack([rows[some], host[near[some].argmax(axis=1)]], axis=1))
        pairs = np.concatenate(edges)
        return pa.Table.from_batches([_found(ids, links, _forest(len(ids), pairs[:, 0], pairs[:, 1]))])

    return run


def _ball_links(judged: DataFrame, threshold: float) -> DataFrame:
    """Links of the balls' members and of their visitors, as _FOUND."""
    members = judged.where("ball >= 0")
    sizes = settle(members.groupBy("ball").agg(F.min("vec_id").alias("first"), F.sum("times").alias("all"), F.ceil(F.count("*") / BALL_ROWS).alias("blocks")))
    inside = members.join(F.broadcast(sizes), "ball").select("vec_id", F.when(F.col("vec_id") != F.col("first"), F.col("first")).alias("other"), (F.col("all") - F.col("times")).alias("links"))
    found = inside.selectExpr("vec_id AS doc_id", "CAST(NULL AS long) AS other", "links").unionByName(inside.where("other IS NOT NULL").selectExpr("vec_id AS doc_id", "other", "CAST(NULL AS long) AS links"))
    guests = judged.where("size(visits) > 0").select("vec_id", "embedding", "times", F.explode("visits").alias("ball"))
    visited = settle(guests.groupBy("ball").agg(F.ceil(F.count("*") / BALL_ROWS).alias("parts")))
    if not visited.limit(1).count():
        return found
    shape = F.broadcast(settle(sizes.join(visited, "ball").select("ball", "blocks", "parts")))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    hosts = members.join(shape, "ball").select("ball", own("blocks").alias("block"), every("parts").alias("part"), F.lit(False).alias("guest"), "vec_id", "embedding", "times")
    come = guests.join(shape, "ball").select("ball", every("blocks").alias("block"), own("parts").alias("part"), F.lit(True).alias("guest"), "vec_id", "embedding", "times")
    return found.unionByName(hosts.unionByName(come).groupBy("ball", "block", "part").applyInArrow(_meet(threshold), _FOUND))


# Shards and graphs


def pivots(vectors: np.ndarray, rounds: int = 6) -> list[tuple[np.ndarray, np.ndarray]]:
    """(cell's centre, numbers of its pivots) over the chosen rows."""
    k = max(1, int(np.sqrt(len(vectors))))
    centres = vectors[:: max(1, len(vectors) // k)][:k].copy()
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                mean = vectors[own == c].mean(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-9)
    own = (vectors @ centres.T).argmax(axis=1)
    return [(centres[c], np.flatnonzero(own == c)) for c in range(len(centres)) if (own == c).any()]


def _assign(sent: object, spread: int) -> Callable:
    """(shards, vec_id, embedding, times): the pivots nearest to a vector in its nearest cells, distinct and rising."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, cells = sent.value
        centres = np.stack([c for c, _ in cells])
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("embedding"))
            near = np.argsort(-(x @ centres.T), axis=1)[:, :spread]
            shard = np.zeros(near.shape, np.int64)
            for c, (_, mine) in enumerate(cells):
                row, j = np.nonzero(near == c)
                if len(row):
                    shard[row, j] = mine[(x[row] @ vectors[mine].T).argmax(axis=1)]
            shard.sort(axis=1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(shard.ravel()), shard.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([lists, *(batch.column(c) for c in ("vec_id", "embedding", "times"))], ["shards", "vec_id", "embedding", "times"])

    return run


def prune(dots: np.ndarray, pool: int = POOL, random: int = RANDOM, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """[rows, degree]: robustly pruned neighbours of every row by all cosines, padded with -1."""
    n = len(dots)
    rng = np.random.default_rng(n)
    out = np.full((n, degree), -1, np.int64)
    k = min(pool, n - 1)
    for a in range(0, n if k else 0, 256):
        rows = np.arange(a, min(n, a + 256))
        every = np.arange(len(rows))
        here = dots[rows].copy()
        here[every, rows] = -2
        near = np.argpartition(-here, k - 1, axis=1)[:, :k]
        cand = np.concatenate([near, rng.integers(0, n, (len(rows), random))], axis=1) if n > pool else near
        own = 2 - 2 * np.take_along_axis(here, cand, axis=1)
        order = np.argsort(own, axis=1)
        cand, own = np.take_along_axis(cand, order, axis=1), np.take_along_axis(own, order, axis=1)
        among = 2 - 2 * dots[cand[:, :, None], cand[:, None, :]]
        alive = own < 5  # not the row itself
        for j in range(degree):
            first = alive.argmax(axis=1)
            some = alive[every, first]
            if not some.any():
                break
            out[rows[some], j] = cand[every, first][some]
            alive &= alpha * alpha * among[every, first] > own
            alive[every, first] = False
    return out


def both_ways(kept: np.ndarray, dots: np.ndarray, most: int) -> np.ndarray:
    """Kept edges in both directions, the nearest ``most`` of each row, padded with -1."""
    n = len(kept)
    src, j = np.nonzero(kept >= 0)
    dst = kept[src, j]
    key = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    src, dst = key // n, key % n
    order = np.lexsort((-dots[src, dst], src))
    src, dst = src[order], dst[order]
    rank = np.arange(len(src)) - np.searchsorted(src, src)
    out = np.full((n, max(1, min(most, int(rank.max(initial=-1)) + 1))), -1, np.int64)
    keep = rank < most
    out[src[keep], rank[keep]] = dst[keep]
    return out


def search(dots: np.ndarray, neighbours: np.ndarray, starts: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, other row) within the threshold, for every row as a query."""
    n = len(dots)
    found = [np.zeros(0, np.int64)]
    for a in range(0, n, 512):
        rows = np.arange(a, min(n, a + 512))
        every = np.arange(len(rows))
        seen = np.zeros((len(rows), n + 1), bool)
        seen[:, n] = True
        ids = np.concatenate([np.tile(starts, (len(rows), 1)), rows[:, None]], axis=1)
        score = dots[rows[:, None], ids].copy()
        fresh = ~np.concatenate([np.zeros((len(rows), len(starts)), bool), (ids[:, :-1] == ids[:, -1:]).any(axis=1, keepdims=True)], axis=1)
        score[~fresh] = -3
        np.put_along_axis(seen, ids, True, axis=1)
        open_ = score > -3
        while True:
            pick = np.where(open_, score, -3).argmax(axis=1)
            going = open_[every, pick]
            if not going.any():
                break
            open_[every, pick] = False
            new = np.where(going[:, None], neighbours[ids[every, pick]], -1)
            new[new < 0] = n
            known = np.take_along_axis(seen, new, axis=1)
            np.put_along_axis(seen, new, True, axis=1)
            near = np.where(known, -3, dots[rows[:, None], np.minimum(new, n - 1)])
            ids, score, open_ = np.concatenate([ids, new], axis=1), np.concatenate([score, near], axis=1), np.concatenate([open_, ~known], axis=1)
            if ids.shape[1] > beam:
                top = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
                ids, score, open_ = (np.take_along_axis(v, top, axis=1) for v in (ids, score, open_))
        r, c = np.nonzero(score >= threshold)
        frontier = np.unique(r * n + ids[r, c])
        within = np.zeros(len(rows) * n, bool)
        within[frontier] = True
        while len(frontier):
            to = neighbours[frontier % n]
            key = np.unique((np.repeat(frontier // n * n, to.shape[1]) + to.ravel())[to.ravel() >= 0])
            key = key[~within[key]]
            frontier = key[dots[rows[key // n], key % n] >= threshold]
            within[frontier] = True
        key = np.flatnonzero(within)
        found.append(rows[key // n] * n + key % n)
    pairs = np.concatenate(found)
    pairs = pairs[pairs // n != pairs % n]
    return pairs // n, pairs % n


def _parts(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of overlapping parts of about ``size`` rows: one if there are no more than twice as many."""
    if len(x) <= 2 * size:
        return [np.arange(len(x))]
    k = -(-2 * len(x) // size)
    heads = x[np.linspace(0, len(x) - 1, k).astype(np.int64)]
    near = np.concatenate([np.argpartition(-(x[a : a + 1000] @ heads.T), 1, axis=1)[:, :2] for a in range(0, len(x), 1000)])
    out = []
    for h in range(k):
        rows = np.flatnonzero((near == h).any(axis=1))
        # Of a part that stays too large (many alike), runs that overlap by half.
        out += [rows] if len(rows) <= 4 * size else [rows[a : a + 2 * size] for a in range(0, len(rows) - size, size)]
    return [rows for rows in out if len(rows) > 1]


def _search_shard(threshold: float, beam: int, size: int) -> Callable:
    """Pairs within the threshold of a shard's members."""

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        x, ids = _unit(part.column("embedding").combine_chunks()), part.column("vec_id").to_numpy()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in _parts(x, size):
            own = x[rows]
            dots = own @ own.T
            neighbours = both_ways(prune(dots), dots, 2 * DEGREE)
            starts = np.unique(np.concatenate([[np.argmax(own @ own.mean(axis=0))], np.linspace(0, len(own) - 1, 3).astype(np.int64)]))
            q, f = search(dots, neighbours, starts, threshold - 1e-5, beam)
            a.append(rows[q])
            b.append(rows[f])
        q, f = np.concatenate(a), np.concatenate(b)
        low, high = np.where(ids[q] < ids[f], q, f), np.where(ids[q] < ids[f], f, q)
        pair = np.unique(low * len(ids) + high)
        low, high = pair // len(ids), pair % len(ids)
        exact = x.astype(np.float64)
        cosine = np.concatenate([np.zeros(0), *(np.einsum("kd,kd->k", exact[low[at : at + 100_000]], exact[high[at : at + 100_000]]) for at in range(0, len(low), 100_000))])
        keep = cosine >= threshold
        return pa.table({"a": ids[low[keep]], "b": ids[high[keep]]})

    return run


def _dot(x: str, y: str) -> Column:
    """Cosine in doubles of two columns of floats."""
    sum_of = lambda a, b: f"aggregate(zip_with({a}, {b}, (p, q) -> double(p) * double(q)), 0D, (s, v) -> s + v)"
    return F.expr(f"{sum_of(x, y)} / sqrt({sum_of(x, x)} * {sum_of(y, y)})")


def _across(pairs: DataFrame, placed: DataFrame, threshold: float) -> DataFrame:
    """pairs and what expansion across shards adds: neighbours of a vector that share no shard, compared until nothing is new."""
    own = placed.select("vec_id", "shards")
    every, new = pairs, pairs
    while True:
        ways = new.unionByName(new.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mixed = ways.join(own.withColumnRenamed("shards", "sa"), F.col("a") == F.col("vec_id")).drop("vec_id").join(own.withColumnRenamed("shards", "sb"), F.col("b") == F.col("vec_id")).drop("vec_id").where("sa != sb")
        mixed = settle(mixed)
        if not mixed.limit(1).count():
            return every
        other = mixed.select("a", F.col("b").alias("c"), F.col("sb").alias("sc"))
        open_ = mixed.select(F.col("b").alias("x"), "a", "sb").join(other, "a").where("x < c AND NOT arrays_overlap(sb, sc)").select(F.col("x").alias("a"), F.col("c").alias("b")).distinct()
        open_ = open_.join(every, ["a", "b"], "left_anti")
        vectors = placed.select("vec_id", "embedding")
        seen = open_.join(vectors.withColumnsRenamed({"vec_id": "a", "embedding": "ea"}), "a").join(vectors.withColumnsRenamed({"vec_id": "b", "embedding": "eb"}), "b")
        new = settle(seen.where(_dot("ea", "eb") >= threshold).select("a", "b"))
        if not new.limit(1).count():
            return every
        every = settle(every.unionByName(new))


def _placed(free: DataFrame, rows: int, shard_rows: int, spread: int, extra: list[np.ndarray]) -> DataFrame:
    drawn = np.concatenate([_drawn(free, rows, min(MOST_PIVOTS, -(-2 * rows // shard_rows)), 11), *extra])
    sent = free.sparkSession.sparkContext.broadcast((drawn, pivots(drawn)))
    return settle(free.mapInArrow(_assign(sent, spread), "shards array<long>, " + _VECTOR).withColumn("shards", F.array_distinct("shards")))


# Exact comparison, for audits and as the last resort


def _brute(sent: object, threshold: float) -> Callable:
    """(query, a, b) of the vectors that were sent with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                y, mine = _unit(part.column("embedding")), part.column("vec_id").to_numpy()
                r, c = np.nonzero(y @ x.T >= threshold - 1e-5)
                keep = mine[r] != ids[c]
                r, c = r[keep], c[keep]
                keep = np.einsum("kd,kd->k", y[r].astype(np.float64), x[c].astype(np.float64)) >= threshold
                query, other = ids[c[keep]], mine[r[keep]]
                yield pa.RecordBatch.from_pydict({"query": query, "a": np.minimum(query, other), "b": np.maximum(query, other)})

    return run


def _exact(vectors: DataFrame, which: Column, threshold: float) -> DataFrame:
    """All pairs of the chosen vectors, which pass through the driver."""
    chosen = vectors.where(which).select("vec_id", "embedding").toArrow().combine_chunks()
    if not chosen.num_rows:
        return vectors.sparkSession.createDataFrame([], "query long, a long, b long")
    sent = vectors.sparkSession.sparkContext.broadcast((chosen.column("vec_id").to_numpy(), _unit(chosen.column("embedding").combine_chunks())))
    return vectors.select("vec_id", "embedding").mapInArrow(_brute(sent, threshold), "query long, a long, b long")


def exact_pairs(vectors: DataFrame, rows: int, threshold: float) -> DataFrame:
    """Every pair (a < b), BLOCK_ROWS vectors at a time with all of them."""
    blocks = -(-rows // BLOCK_ROWS)
    of = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks))
    out = None
    for k in range(blocks):
        one = settle(_exact(vectors, of == k, threshold).where("query = a").drop("query"))
        out = one if out is None else out.unionByName(one)
    return out


def recall(truth: DataFrame, pairs: DataFrame) -> float:
    """Mean over the audited rows that have partners of the share of these that was found; 1 if none has."""
    found = truth.join(pairs.select("a", "b", F.lit(1.0).alias("found")), ["a", "b"], "left")
    share = found.groupBy("query").agg(F.avg(F.coalesce("found", F.lit(0.0))).alias("share")).agg(F.avg("share")).first()[0]
    return 1.0 if share is None else share


def near_pairs(free: DataFrame, rows: int, threshold: float = THRESHOLD, beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a < b) of distinct vectors (vec_id, embedding, times) by the graph, audited."""
    size = AUDIT
    while True:
        truth = settle(_exact(free, F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(rows)) < size, threshold))
        if size >= rows:
            return truth.where("query = a").select("a", "b")
        if size >= BLOCK_ROWS or truth.select("query").distinct().count() >= PARTNERED:
            break
        size *= 2
    for spread, wider in ATTEMPTS:
        extra: list[np.ndarray] = []
        last = None
        while True:
            placed = _placed(free, rows, shard_rows, spread, extra)
            sizes = settle(placed.select(F.explode("shards").alias("shard")).groupBy("shard").count())
            most = sizes.agg(F.max("count")).first()[0]
            if most <= MOST_ROWS or last is not None and most > 0.9 * last:
                break  # what cannot be told apart stays together: a shard is cut into parts in any case
            last = most
            large = sizes.where(F.col("count") > MOST_ROWS).select(F.col("shard").alias("home"))
            within = settle(placed.join(F.broadcast(large), F.array_contains("shards", F.col("home")), "left_semi").select("vec_id", "embedding"))
            extra.append(_drawn(within, within.count(), SAMPLE, 13 + len(extra)))
        members = placed.select(F.explode("shards").alias("shard"), "vec_id", "embedding")
        pairs = settle(members.groupBy("shard").applyInArrow(_search_shard(threshold, wider * beam, shard_rows), "a long, b long").distinct())
        pairs = _across(pairs, placed, threshold)
        if recall(truth, pairs) >= TARGET:
            return pairs
    return exact_pairs(free, rows, threshold)


def near_classes(embeddings: DataFrame, threshold: float = THRESHOLD, beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, class_id, links) of every vector: what links connect has the class of its lowest
    vec_id; links counts the other vectors whose cosine with this one is threshold or more."""
    spark = embeddings.sparkSession
    sound = "size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists(embedding, x -> x != 0)"
    rows_of = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("vec_id IS NOT NULL")
    every = rows_of.select("vec_id").distinct()
    length = rows_of.where(sound).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return every.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    own = settle(rows_of.where(sound).where(F.size("embedding") == length["d"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    distinct = settle(own.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times")).select("vec_id", "embedding", "times"))
    copies = settle(own.join(small(distinct.where("times > 1").select(F.col("vec_id").alias("lead"), "embedding", "times"), 100_000), "embedding").select("vec_id", "lead", "times"))
    rows, angle = distinct.count(), np.arccos(threshold)
    half, reach = float(np.cos(angle / 2 - 1e-4)), float(np.cos(min(1.5 * angle + 1e-4, np.pi)))
    centres = crowded(_drawn(distinct, rows, SAMPLE, 7), half)
    free, found = distinct, spark.createDataFrame([], _FOUND)
    if len(centres):
        sent = spark.sparkContext.broadcast(centres)
        judged = settle(distinct.mapInArrow(_judge(sent, half, reach), _VECTOR + ", ball int, visits array<int>"))
        found = _ball_links(judged, threshold)
        free = judged.where("ball < 0").select("vec_id", "embedding", "times")
        rows = free.count()
    if rows:
        pairs = settle(near_pairs(free, rows, threshold, beam, shard_rows))
        times = small(settle(distinct.where("times > 1").select("vec_id", "times")))
        ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        counts = ways.join(times, F.col("b") == F.col("vec_id"), "left").groupBy("a").agg(F.sum(F.coalesce("times", F.lit(1))).alias("links"))
        found = found.unionByName(counts.selectExpr("a AS doc_id", "CAST(NULL AS long) AS other", "links")).unionByName(pairs.selectExpr("a AS doc_id", "b AS other", "CAST(NULL AS long) AS links"))
    found = settle(found)
    classes = groups(found.where("other IS NOT NULL").select(F.col("doc_id").alias("doc_id_a"), F.col("other").alias("doc_id_b")))
    links = settle(found.where("other IS NULL").groupBy("doc_id").agg(F.sum("links").alias("found")).join(classes, "doc_id", "left").select(F.col("doc_id").alias("lead"), "found", "group"))
    named = every.join(small(copies), "vec_id", "left").withColumn("lead", F.coalesce("lead", "vec_id"))
    return named.join(small(links), "lead", "left").select("vec_id", F.coalesce("group", "lead").alias("class_id"), (F.coalesce("found", F.lit(0)) + F.coalesce("times", F.lit(1)) - 1).alias("links"))
