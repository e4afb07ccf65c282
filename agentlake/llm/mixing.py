"""Operator 5: mixing sources to target weights by Pfair scheduling.

A source's documents, in the order of a hash, are cut into blocks of ``block_chars``
characters (BLOCK_CHARS, or a BLOCKS-th of the corpus if that is more).  With target
weight w, its i-th block may not come before slot ``floor(i / w)`` nor after
``ceil((i + 1) / w)``; one block is placed in each slot, earliest deadline first.  At
every slot each source is then less than one block away from its share.  Weights are
taken exactly as they are given (floats are fractions; release times and deadlines are
whole-number arithmetic), so that this holds at any slot, for any weights.

The mix is as long as it takes until every source has been used once; sources with a
large weight for their size are repeated (epochs), and no document is left out.
Without given weights a source's weight is its number of blocks to the power
TEMPERATURE.  A caller may give ``max_epochs``: then the weight of sources that would be
repeated more often is lowered, and the mix is that of the lowered weights.

Blocks come from prefix sums in two levels (within a bucket of the hash, and over the
bucket totals) of hashes and lengths, so that no task holds a whole source.  The
driver simulates the schedule, about two microseconds a slot, and sends where each block
begins and its slots: BLOCKS blocks and MOST_SLOTS slots at most (more is an error that
asks for max_epochs).  Texts are moved once, if the documents are put in order, and not
at all by ``mix``.

Defined results: a null source counts as source ''; a null or empty text has length 0
and takes its place; a null doc_id is a doc_id like any other; a text longer than a
block takes the slots of all blocks that it covers, and is placed in the first; rows
that repeat doc_id and text are scheduled each, in one block; sources that given weights
leave out or give 0 are left out; weights below 0 or not finite are an error; ties in the
schedule go to the source that sorts first; an empty table gives no rows; other columns do
not matter and may have any names.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import named, partitions, settle, unused

BLOCK_CHARS, BLOCKS, MOST_SLOTS, TEMPERATURE, BUCKET_ROWS, SEED = 100_000, 1_000_000, 50_000_000, 0.7, 50_000, 7


def whole_weights(weights: dict[str, float | Fraction]) -> dict[str, int]:
    """The weights as whole numbers, in exactly the same proportion."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    out = {s: int(w * scale) for s, w in exact.items()}
    common = math.gcd(*out.values())
    return {s: w // common for s, w in out.items()}


def slots_needed(blocks: dict[str, int], weights: dict[str, int]) -> int:
    """The slot by which every source has been used once."""
    total = sum(weights.values())
    return max(-(-blocks[s] * total // w) for s, w in weights.items())


def schedule(weights: dict[str, int], slots: int) -> dict[str, np.ndarray]:
    """The slots of each source's blocks among so many, earliest deadline first."""
    names = sorted(weights)
    w = [weights[s] for s in names]
    total = sum(w)
    done, out = [0] * len(w), [[] for _ in w]
    waiting, ready = [(0, s) for s in range(len(w))], []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * total // w[s]), s))
        deadline, s = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        out[s].append(t)
        done[s] += 1
        heapq.heappush(waiting, (done[s] * total // w[s], s))
    return {name: np.array(x, np.int64) for name, x in zip(names, out, strict=True)}


def lowered(blocks: dict[str, int], weights: dict[str, float], max_epochs: int) -> dict[str, Fraction]:
    """Weights with which no source is repeated more than max_epochs times."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = max(blocks[s] / w for s, w in exact.items())
    return {s: min(Fraction(max_epochs * blocks[s]), scale * w) for s, w in exact.items()}


def _begins(docs: DataFrame, source: str, chars: str, hashed: str, rows: int, block_chars: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each source the blocks in which documents begin, rising, and the hash at which each does."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    bucket = F.expr(f"((`{hashed}` >> 32) + 2147483648L) * {buckets} div 4294967296L").alias("bucket")
    each = docs.groupBy(F.col(source).alias("source"), bucket, F.col(hashed).alias("hash")).agg(F.sum(chars).alias("chars"))
    each = settle(each.where("source IS NOT NULL"))
    totals = each.groupBy("source", "bucket").agg(F.sum("chars").alias("chars"))
    before = F.sum("chars").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.sum("chars").over(Window.partitionBy("source", "bucket").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1))
    placed = each.select("source", "bucket", "hash", F.coalesce(within, F.lit(0)).alias("before")).join(offsets, ["source", "bucket"])
    found = placed.groupBy("source", F.expr(f"(offset + before) div {block_chars}").alias("block")).agg(F.min("hash").alias("hash")).toPandas()
    return {s: (g["block"].to_numpy(), g["hash"].to_numpy()) for s, g in found.sort_values(["source", "hash"]).groupby("source")}


def placed(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int | None = None, max_epochs: int | None = None, seed: int = SEED) -> tuple[DataFrame, dict[str, str], int]:
    """docs with the columns source, epoch, block, slot and hash added under unused names; these names; the number of slots."""
    if weights is not None and any(not 0 <= w < math.inf for w in weights.values()):
        raise ValueError("weights must be finite and not below 0")
    names: dict[str, str] = {}
    for c in ("source", "chars", "hash", "epoch", "block", "slot", "found"):
        names[c] = unused([*docs.columns, *names.values()], f"__mix_{c}")
    own = docs.withColumns({names["source"]: F.coalesce(F.col("source").cast("string"), F.lit("")), names["chars"]: F.coalesce(F.length("text"), F.lit(0)).cast("long"), names["hash"]: F.xxhash64("doc_id", "text", F.lit(seed))})
    slim = own.select(names["source"], names["chars"], names["hash"])
    sizes = slim.groupBy(names["source"]).agg(F.count("*"), F.sum(names["chars"])).collect()
    block_chars = block_chars or max(BLOCK_CHARS, -(-sum(r[2] for r in sizes) // BLOCKS))
    blocks = {r[0]: max(1, -(-r[2] // block_chars)) for r in sizes}
    given = {s: w for s, w in (weights if weights is not None else {s: n**TEMPERATURE for s, n in blocks.items()}).items() if s in blocks and w > 0}
    slots, order, begins = 0, {}, {}
    if given:
        exact = whole_weights(lowered(blocks, given, max_epochs) if max_epochs else given)
        slots = slots_needed(blocks, exact)
        if slots > MOST_SLOTS:
            raise ValueError(f"every source is used once after {slots} slots only; set max_epochs, or larger blocks")
        order = schedule(exact, slots)
        begins = _begins(slim.where(F.col(names["source"]).isin(list(order))) if weights is not None else slim, *(names[c] for c in ("source", "chars", "hash")), max(r[1] for r in sizes), block_chars)
    sent = docs.sparkSession.sparkContext.broadcast({s: (begins[s][1], np.minimum(begins[s][0], blocks[s] - 1), blocks[s], order[s]) for s in order})

    @F.pandas_udf("block long, slots array<long>")
    def find(source: pd.Series, hashed: pd.Series) -> pd.DataFrame:
        block, found = np.zeros(len(source), np.int64), np.empty(len(source), object)
        number, every = pd.factorize(source)
        for i, name in enumerate(every):
            rows = np.flatnonzero(number == i)
            if name not in sent.value:
                found[rows] = [[]] * len(rows)
                continue
            at, blocks_at, count, turns = sent.value[name]
            block[rows] = blocks_at[np.searchsorted(at, hashed.to_numpy()[rows], side="right") - 1]
            kinds, back = np.unique(block[rows], return_inverse=True)
            lists = np.empty(len(kinds), object)
            lists[:] = [turns[b::count] for b in kinds.tolist()]
            found[rows] = lists[back]
        return pd.DataFrame({"block": block, "slots": found})

    found = own.withColumn(names["found"], find(names["source"], names["hash"]))
    kept = [F.col(named(c)) for c in [*docs.columns, names["source"], names["hash"]]]
    return found.select(*kept, F.col(names["found"])["block"].alias(names["block"]), F.posexplode(F.col(names["found"])["slots"]).alias(names["epoch"], names["slot"])), names, slots


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """(doc_id, source, epoch, block, slot) of every placing of a document."""
    found, names, _ = placed(docs.select("doc_id", "source", "text"), **options)
    return found.select("doc_id", F.col(names["source"]).alias("source"), F.col(names["epoch"]).cast("long").alias("epoch"), F.col(names["block"]).alias("block"), F.col(names["slot"]).alias("slot"))


def interleave(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs in the order of the mix, a row as often as it is placed."""
    found, names, slots = placed(docs, **options)
    parts = partitions(docs.sparkSession)
    part = F.expr(f"CAST(`{names['slot']}` * {parts} div {max(slots, 1)} AS int)")
    return found.repartitionById(parts, part).sortWithinPartitions(names["slot"], names["hash"], "doc_id").select(*(named(c) for c in docs.columns))
