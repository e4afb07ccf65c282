"""Operator 2: benchmark decontamination by edit distance.

An item of n words is found in a document if some run of the document's words
is within ``floor(max_edits * n)`` word insertions, deletions and
substitutions of it (case and punctuation aside).

Candidates come from a CGK random walk: a sequence is read through a pointer
that stays or moves on by one, as a random function of the step and of the
word under it decides; the words read are the embedding.  Sequences at a small
edit distance get embeddings at a small Hamming distance, so bit sampling
applies: a repetition looks at ``SAMPLED`` random places of the embedding and
compares them with those of the items.  The windows are item-sized: items form
classes by length (powers of two), and one window of its class's length
starts at every word of every document.  A window is walked only as far as the
sampled places that it still matches; most leave at the first one.
The walks drift apart with each edit, so items of 2 * PIECE words and more are
entered by windows of PIECE words' class from every PIECE-th word on instead: one
of these holds no more than its share of the edits, and any that matches will do.
``REPETITIONS`` are set for a recall of 0.95 and more at the permitted edits.
Candidates are then verified exactly against the whole item (bit-parallel edit
distance).  Items that permit no edit (fewer than 10 words by default) are looked
up by a hash of their whole word sequence at every word instead: all are found.

Documents are scanned once where they lie; only the items travel, in slices
of ITEMS_AT_ONCE items or CHARS_AT_ONCE characters by broadcast, whatever their
number (a scan a slice).  Filters are sized by the entries of their class and
packed: an index takes about 1 KB an entry.

Defined results: null and empty items, and ones without words, never match; an item
of one word is found wherever the word stands (give ``min_words`` to leave such items
out); null and empty texts match nothing; rows without doc_id, or items without
item_id, are left out of the pairs; repeated rows and items count once, and an item_id or a doc_id with
several texts has its least distance; other columns do not matter; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import identified, without

MAX_EDITS, MIN_WORDS, REPETITIONS, SAMPLED, ITEMS_AT_ONCE, CHARS_AT_ONCE, PIECE = 0.1, 1, 12, 4, 50_000, 8_000_000, 32
_SEED = 20_240_607


class Index:
    """Bit-sampling tables over the CGK embeddings of item-sized windows."""

    def __init__(self, items: list[tuple[int, str]], max_edits: float, repetitions: int, min_words: int = MIN_WORDS):
        words = tv.Words([t for _, t in items])
        count = np.diff(words.first)
        self.ids = [i for i, _ in items]
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.limit = [int(max_edits * n + 1e-9) for n in count.tolist()]
        hashes, begin = _parted(words)
        # Items that permit no edit: (words, sorted hashes of whole items, items).
        self.exact = []
        for n in sorted({n for n, limit in zip(count.tolist(), self.limit, strict=True) if n >= max(min_words, 1) and not limit}):
            of = np.flatnonzero(count == n)
            key = _runs(words.hash, n)[words.first[of]]
            order = np.argsort(key, kind="stable")
            self.exact.append((n, key[order], of[order]))
        wanted = np.array(self.limit, np.int64) > 0
        # Entries: (item, first word of it that the window begins with, length that decides on the class).
        pieces = [[] if not edits or n < min_words else list(range(0, n - PIECE + 1, PIECE)) if n >= 2 * PIECE else [0] for n, edits in zip(count.tolist(), wanted.tolist(), strict=True)]
        self.item = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        self.shift = np.array([a for p in pieces for a in p], np.int64)
        begin, count = begin[self.item] + self.shift, np.where(count >= 2 * PIECE, PIECE, count)[self.item]
        random = np.random.default_rng(_SEED)
        lows = sorted({1 << (n.bit_length() - 1) for n in count.tolist()})
        self.repetitions = []
        for _ in range(repetitions if lows else 0):
            seed = np.uint64(random.integers(1 << 63))
            classes = []
            for low in lows:
                of = np.flatnonzero((count >= low) & (count < 2 * low))
                places = np.sort(random.choice(2 * low, size=min(SAMPLED, 2 * low), replace=False)).tolist()
                at, done, key, filters = begin[of], 0, np.zeros(len(of), np.uint64), []
                turns = _turns(hashes, seed)
                for place in places:
                    at, done = _walk(at, turns, done, place), place
                    key = tv.mix64(key ^ hashes[at])
                    # Every word is held against the first filter, few against the others, which are packed.
                    size = 1 << (max((64 if filters else 16) * len(of), 1 << 12) - 1).bit_length()
                    bits = np.zeros(size, bool)
                    bits[key & np.uint64(size - 1)] = True
                    filters.append(np.packbits(bits, bitorder="little") if filters else bits)
                order = np.argsort(key, kind="stable")
                classes.append((places, filters, key[order], of[order]))
            self.repetitions.append((seed, sorted(classes, key=lambda c: c[0][0])))

    def candidates(self, words: tv.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word of the window, number of the entry), distinct and sorted."""
        starts, entries = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        hashes, _ = _parted(words)
        symbol = tv.mix64(hashes)
        for seed, classes in self.repetitions:
            turns = _turns(hashes, seed)
            every, reached = np.arange(len(hashes)), 0
            for places, filters, table, entry in classes:
                every, reached = _walk(every, turns, reached, places[0]), places[0]
                alive = np.flatnonzero(filters[0][symbol & np.uint64(len(filters[0]) - 1)][every])
                at, key, done = every[alive], symbol[every[alive]], places[0]
                for place, bits in zip(places[1:], filters[1:], strict=True):
                    at, done = _walk(at, turns, done, place), place
                    key = tv.mix64(key ^ hashes[at])
                    bit = key & np.uint64(8 * len(bits) - 1)
                    keep = np.flatnonzero(bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & np.uint8(1))
                    alive, at, key = alive[keep], at[keep], key[keep]
                low, high = np.searchsorted(table, key), np.searchsorted(table, key, side="right")
                starts.append(np.repeat(alive, high - low))
                entries.append(entry[tv.ranges(low, high - low)])
        place = np.concatenate(starts)
        doc = np.searchsorted(words.first[1:] + np.arange(len(words.first) - 1), place)
        # A window that begins at a document's end mark begins after its last word.
        pair = np.unique((place - doc) * max(len(self.item), 1) + np.concatenate(entries))
        return pair // max(len(self.item), 1), pair % max(len(self.item), 1)


    def whole(self, words: tv.Words) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) of items that permit no edit, distinct and sorted."""
        doc = words.doc_of_word()
        found = [np.zeros(0, np.int64)]
        for n, table, item in self.exact:
            if len(words.hash) < n:
                continue
            start = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
            key = _runs(words.hash, n)[start]
            at = np.minimum(np.searchsorted(table, key), len(table) - 1)
            start, key = start[table[at] == key], key[table[at] == key]
            low, high = np.searchsorted(table, key), np.searchsorted(table, key, side="right")
            found.append(np.unique(np.repeat(doc[start], high - low) * len(self.ids) + item[tv.ranges(low, high - low)]))
        pair = np.unique(np.concatenate(found))
        return pair // max(len(self.ids), 1), pair % max(len(self.ids), 1)


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each word on."""
    out = np.zeros(len(hashes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(n, len(hashes))):
            out[: len(hashes) - k] += tv.mix64(hashes[k:] ^ np.uint64(_SEED)) * np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64))
    return tv.mix64(out)


def _parted(words: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with a 0 after each document, where a pointer rests; each document's begin."""
    docs = np.arange(len(words.first) - 1)
    out = np.zeros(len(words.hash) + len(docs), np.uint64)
    out[np.arange(len(words.hash)) + words.doc_of_word()] = words.hash
    return out, words.first[:-1] + docs


def _turns(hashes: np.ndarray, seed: np.uint64) -> np.ndarray:
    """64 random decisions of each word, in 8 rows of bytes; an end mark stays."""
    bits = tv.mix64(hashes ^ seed)
    bits[hashes == 0] = 0
    return np.ascontiguousarray(bits.view(np.uint8).reshape(-1, 8).T)


def _walk(at: np.ndarray, turns: np.ndarray, a: int, b: int) -> np.ndarray:
    """Pointers after the steps a to b-1."""
    for j in range(a, b):
        at = at + (turns[j >> 3 & 7][at] >> np.uint8(j & 7) & np.uint8(1))
    return at


def edit_distance(pattern: list[int], text: list[int], limit: int) -> int:
    """Least edits between the pattern and any run of the text (Myers' bit vectors), or limit + 1."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[int, int] = {}
    for i, w in enumerate(pattern):
        equal[w] = equal.get(w, 0) | 1 << i
    up, down, score, best = full, 0, m, m
    for w in text:
        eq = equal.get(w, 0)
        x = eq | down
        d = (((x & up) + up) ^ up) | x
        right, left = down | (full & ~(d | up)), up & d
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        best = min(best, score)
        right, left = right << 1 & full, left << 1 & full
        up = left | (full & ~(x | right))
        down = right & x
    return best if best <= limit else limit + 1


def _scan(index: object) -> Callable:
    def found(part: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
        """(row, item, distance) for everything that is in the batch."""
        its = index.value
        words = tv.Words(part.column("text").to_pylist())
        for d, i in zip(*(x.tolist() for x in its.whole(words)), strict=True):
            yield d, i, 0
        start, entry = its.candidates(words)
        doc = np.minimum(np.searchsorted(words.first, start, side="right") - 1, len(words.first) - 2)
        item, start = its.item[entry], start - its.shift[entry]  # where the item would begin, were there no edits before
        # Neighbouring windows with the same item are one stretch of text to compare.
        order = np.lexsort((start, item, doc))
        start, item, doc = start[order], item[order], doc[order]
        # A window may begin before or after the item's own first word, by edits as well as by the walk.
        reach = np.array([len(its.words[i]) + 2 * its.limit[i] for i in item.tolist()], dtype=np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] > start[:-1] + reach[:-1])
        at = np.flatnonzero(new)
        for a, b in zip(at.tolist(), np.append(at[1:], len(start))[: len(at)].tolist(), strict=True):
            i, d, limit = int(item[a]), int(doc[a]), its.limit[int(item[a])]
            low = max(int(words.first[d]), int(start[a]) - 2 * limit)
            high = min(int(words.first[d + 1]), int(start[b - 1]) + int(reach[b - 1]))
            distance = edit_distance(its.words[i].tolist(), words.hash[low:high].tolist(), limit)
            if distance <= limit:
                yield d, i, distance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        its = index.value
        for batch in batches:
            for part in tv.slices(batch):
                hits = list(found(part))
                ids = part.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([ids[d] for d, _, _ in hits], pa.int64()),
                    "item_id": pa.array([its.ids[i] for _, i, _ in hits], pa.int64()),
                    "distance": pa.array([x for *_, x in hits], pa.int32()),
                    "item_words": pa.array([len(its.words[i]) for _, i, _ in hits], pa.int32()),
                })

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, repetitions: int = REPETITIONS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, distance, item_words) for every item found in a document."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    whole = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    slices = max(1, -(-whole["n"] // ITEMS_AT_ONCE), -(-(whole["chars"] or 0) // CHARS_AT_ONCE))
    out = None
    for i in range(slices):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in mine], max_edits, repetitions, min_words))
        one = identified(docs, "text").mapInArrow(_scan(index), "doc_id long, item_id long, distance int, item_words int")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.min_by("item_words", F.struct("distance", "item_words")).alias("item_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, repetitions: int = REPETITIONS, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs in which no item is found; rows without doc_id stay."""
    return without(docs, contaminated(docs, benchmark, max_edits, repetitions, min_words).select("doc_id").distinct())
