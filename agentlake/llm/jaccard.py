"""Operator 7: exact n-gram Jaccard self-join with adaptive multi-match prefixes.

Every document is its set of word n-grams.  Two sets whose Jaccard index is
at least ``threshold`` share at least ``ceil(threshold * size)`` members of
either one, so for any l >= 1 their first ``size - ceil(threshold * size) + l``
members under one global order share at least l.  The order is rare-first
(exact document frequencies over the whole corpus, frequent n-grams last).
Each document picks its own l: the estimated cost of its posting lists plus
that of verifying its candidates (bounded by the summed frequencies over l)
is least.  A pair needs ``min(l_a, l_b)`` shared prefix members before its
sets are compared, which loses no pair.

The result has one row per document: its class (what links connect) and its
number of links, so that it grows with the documents and not with the pairs.
Equal texts are collapsed before the join; the lowest doc_id stands for them
and its links count as often as there are copies.

Large groups of different texts would still meet in every posting list that
they share.  Each document has SIGNS min-hashes; a value that HOT_GROUP
documents or more have in common makes a hot bucket, inside which sets are
compared block by block as matrices of n-grams, and only counts and a spanning
forest leave the task.  Posting lists leave out pairs that share a hot bucket.

Shuffled are: n-gram fingerprints with their counts, for the frequencies; the
prefixes as byte-transposed blocks; pair counts; and the texts of documents
that have candidates.  Lists of more than LIST_ROWS and keys of more than
CELL_PAIRS pairs are split into cells.  No broadcast grows unchecked: the
frequency table has at most HOT_ROWS rows (rarer n-grams count as equally rare,
which changes the order alone), the hot buckets are the HOT_BUCKETS largest (the
others' pairs go through the lists), id lists go by shuffle beyond
common.BROADCAST_IDS.

Defined results: a null or empty text is linked to nothing, one without words
to equal texts only; a text of fewer than n words has its word sequence as its
one member; rows without doc_id are left out; repeated rows count once, and of
several texts of one doc_id the one of the least MD5 counts; a document is
never linked to itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from . import textvec as tv
from .common import identified, named, partitions, settle, small, without

N, THRESHOLD = 3, 0.6
#: Most n-grams whose frequency is told apart, and the least frequency that is.
HOT_ROWS, HOT_DF = 2_000_000, 16
#: Cost of comparing two sets, in posting pairs; the prefix extensions tried.
VERIFY_COST, EXTENSIONS = 200, (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
_FLUSH = 400_000
#: Ranges of the hash space for each shuffle partition; a task has one range.
RANGES = 2
#: Min-hashes of a document; documents that make a bucket hot; buckets told apart; documents of a block.
SIGNS, HOT_GROUP, HOT_BUCKETS, BLOCK_DOCS = 4, 128, 200_000, 2048
#: Rows of a posting list, pairs of a key, and counted pairs held, beyond which they are split or passed on.
LIST_ROWS, CELL_PAIRS, HELD_PAIRS = 20_000, 200_000, 400_000
#: Entries of prefixes, or fingerprints, in a batch on its way back from Python.
BATCH_ENTRIES = 50_000
_TOP = np.uint64(16)  # a fingerprint is the upper 40 of an n-gram's 56 bits


def _pack(x: np.ndarray) -> bytes:
    """Bytes by significance, which the shuffle's compression takes well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in tv.slices(batch):
            value, first = tv.shingles(tv.Words(part.column("text").to_pylist()), n)
            yield part.column("doc_id").to_numpy(), value, first


def _by_range(key: np.ndarray, ranges: int) -> list[int]:
    """Cuts of sorted 40-bit fingerprints into equal ranges of the hash space."""
    return np.searchsorted(key, np.array([(i << 40) // ranges for i in range(ranges + 1)], dtype=np.uint64)).tolist()


def _fingerprints(n: int, ranges: int) -> Callable:
    """Map side of the document frequencies: distinct fingerprints, as steps, and their counts, by range."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, count = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        cuts = _by_range(key, ranges)
        part, first, steps, counts, last = [], [], [], [], 0
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                part.append(i)
                first.append(int(key[a]))
                steps.append(_pack(np.diff(key[a:b], prepend=key[a : a + 1]).astype(np.uint64)))
                counts.append(_pack(count[a:b].astype(np.uint32)))
            if b - last > BATCH_ENTRIES or b == len(key) and b > last:
                yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "first": pa.array(first, pa.int64()), "steps": pa.array(steps, pa.binary()), "counts": pa.array(counts, pa.binary())})
                part, first, steps, counts, last = [], [], [], [], b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, value, _ in _sets(batches, n):
            held.append(value >> _TOP)
            size += len(value)
            if size > 2 * _FLUSH:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _frequencies(least: int) -> Callable:
    """Reduce side: how often each fingerprint of a range occurs, if often; of
    the others, how many there are of each frequency (key -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            for first, steps, n in zip(*(batch.column(c).to_pylist() for c in ("first", "steps", "counts")), strict=True):
                keys.append(np.cumsum(_unpack(steps, np.uint64)) + np.uint64(first))
                counts.append(_unpack(n, np.uint32))
        if not keys:
            return
        key, count = np.concatenate(keys), np.concatenate(counts)
        keys, counts = [], []
        order = np.argsort(key)
        key, count = key[order], count[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        df = np.add.reduceat(count.astype(np.int64), at)
        keep = df >= least
        yield pa.RecordBatch.from_pydict({"key": key[at[keep]].astype(np.int64), "df": df[keep], "n": np.ones(keep.sum(), np.int64)})
        del key, count, order
        tv.release()
        kinds = np.bincount(df[~keep], minlength=least).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"key": np.full(len(kinds), -1, np.int64), "df": np.arange(len(kinds)), "n": kinds})

    return run


def _hot(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The frequent fingerprints, sorted, with their document frequencies, and
    how many other documents an occurrence of another fingerprint meets on average."""
    ranges = RANGES * partitions(docs.sparkSession)
    found = settle(
        docs.mapInArrow(_fingerprints(n, ranges), "part int, first long, steps binary, counts binary")
        .repartitionById(ranges, "part")
        .mapInArrow(_frequencies(HOT_DF), "key long, df long, n long")
    )
    steps = [HOT_DF << i for i in range(24)]
    counts = found.agg(*(F.sum(F.when(F.col("df") >= s, F.col("n")).otherwise(0)).alias(str(s)) for s in steps)).first()
    least = next(s for s in steps if (counts[str(s)] or 0) <= HOT_ROWS)
    rare = found.where(F.col("df") < least).agg(F.sum(F.expr("n * df * (df - 1D)")).alias("met"), F.sum(F.expr("n * df")).alias("all")).first()
    rows = found.where(F.col("df") >= least).toArrow().combine_chunks()
    key, df = (rows.column(c).to_numpy() for c in ("key", "df"))
    order = np.argsort(key)
    return key[order].astype(np.uint64), df[order], (rare["met"] or 0.0) / max(rare["all"] or 0, 1)


def _signs(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[SIGNS, documents]: min-hashes of the sets; of an empty one, 0."""
    out = np.zeros((SIGNS, len(first) - 1), np.uint64)
    full = np.flatnonzero(np.diff(first) > 0)
    with np.errstate(over="ignore"):
        for i in range(SIGNS if len(full) else 0):
            turned = value * np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) + (i << 33) & (1 << 64) - 1 | 1)
            out[i, full] = tv.mix64(np.minimum.reduceat(turned, first[:-1][full]) + np.uint64(i)) | np.uint64(1)
    return out


def _signed_docs(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, value, first in _sets(batches, n):
            signs = _signs(value, first)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(tv.signed(x)) for x in signs)], ["doc_id", *(f"s{i}" for i in range(SIGNS))])

    return run


def _buckets(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(doc_id, s0..) of all documents; the hot buckets' values, sorted, and how many documents each has."""
    signs = settle(docs.mapInArrow(_signed_docs(n), "doc_id long, " + ", ".join(f"s{i} long" for i in range(SIGNS))))
    each = signs.select(F.explode(F.array(*(f"s{i}" for i in range(SIGNS)))).alias("sign")).where("sign != 0")
    counts = settle(each.groupBy("sign").count().where(F.col("count") >= HOT_GROUP))
    steps = [HOT_GROUP << i for i in range(40)]
    many = counts.agg(*(F.count_if(F.col("count") >= s).alias(str(s)) for s in steps)).first()
    least = next(s for s in steps if many[str(s)] <= HOT_BUCKETS)
    rows = counts.where(F.col("count") >= least).toArrow().combine_chunks()
    value, size = rows.column("sign").to_numpy().view(np.uint64), rows.column("count").to_numpy()
    order = np.argsort(value)
    return signs, value[order], size[order]


def _look_up(signs: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """[documents, SIGNS]: the number of each hot bucket, from 1; 0 where a sign is not hot."""
    if not len(hot):
        return np.zeros(signs.T.shape, np.int32)
    at = np.minimum(np.searchsorted(hot, signs), len(hot) - 1)
    return np.ascontiguousarray(np.where(hot[at] == signs, at + 1, 0).astype(np.int32).T)


def _cells(sent: object) -> Callable:
    """(bucket, x, y, own, doc_id, hot): each document of a hot bucket in every cell (x, y) of two blocks of which one is its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, size = sent.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            hot = _look_up(np.stack([batch.column(f"s{i}").to_numpy().view(np.uint64) for i in range(SIGNS)]), value)
            row, sign = np.nonzero(hot)
            bucket = hot[row, sign]
            blocks = -(-size[bucket - 1] // BLOCK_DOCS)
            own = (tv.mix64(ids[row].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
            other = tv.ranges(np.zeros(len(row), np.int64), blocks)
            row, bucket, own = (np.repeat(x, blocks) for x in (row, bucket, own))
            for at in range(0, len(row), 50_000):
                cut = slice(at, at + 50_000)
                flat = hot[row[cut]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cut]), *(pa.array(x[cut].astype(np.int32)) for x in (np.minimum(own, other), np.maximum(own, other), own)), pa.array(ids[row[cut]]), pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), SIGNS).cast(pa.list_(pa.int32()))],
                    ["bucket", "x", "y", "own", "doc_id", "hot"],
                )

    return run


class _Members:
    """The n-grams of a cell's documents: those that many have as a matrix, of the others the documents listed."""

    def __init__(self, value: np.ndarray, first: np.ndarray):
        self.first, docs = first, len(first) - 1
        doc = np.repeat(np.arange(docs), np.diff(first))
        _, column, df = np.unique(value, return_inverse=True, return_counts=True)
        wide, rare = df > max(docs // 32, 8), (df > 1) & (df <= max(docs // 32, 8))
        self.matrix = np.zeros((docs, int(wide.sum())), np.float32)
        on = wide[column]
        self.matrix[doc[on], (np.cumsum(wide) - 1)[column[on]]] = 1
        self.listed = np.where(rare, np.cumsum(rare) - 1, -1)[column]
        order = np.argsort(self.listed, kind="stable")[int((self.listed < 0).sum()) :]
        self.docs, self.begin = doc[order], np.concatenate([[0], np.cumsum(df[rare])])

    def shared(self, rows: np.ndarray) -> np.ndarray:
        """[rows, documents]: how many n-grams the rows have in common with each document."""
        out = self.matrix[rows] @ self.matrix.T
        count = self.first[rows + 1] - self.first[rows]
        listed, owner = self.listed[tv.ranges(self.first[rows], count)], np.repeat(np.arange(len(rows)), count)
        listed, owner = listed[listed >= 0], owner[listed >= 0]
        length = self.begin[listed + 1] - self.begin[listed]
        at = np.repeat(owner, length) * out.shape[1] + self.docs[tv.ranges(self.begin[listed], length)]
        if len(at):
            out += np.bincount(at, minlength=out.size).reshape(out.shape).astype(np.float32)
        return out


def _forest(docs: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (root, document) that connect what the pairs connect."""
    label = np.arange(docs)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    return [(int(label[i]), int(i)) for i in np.flatnonzero(label != np.arange(docs))]


_FOUND = "doc_id long, other long, links long"


def _found(ids: np.ndarray, links: np.ndarray, forest: list[tuple[int, int]]) -> pa.RecordBatch:
    """Rows (doc_id, null, links) and (root, document, null)."""
    some = np.flatnonzero(links)
    doc = np.concatenate([ids[some], np.array([ids[r] for r, _ in forest], np.int64)])
    other = np.concatenate([np.zeros(len(some), np.int64), np.array([ids[d] for _, d in forest], np.int64)])
    edge = np.arange(len(doc)) >= len(some)
    count = np.concatenate([links[some], np.zeros(len(forest), np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(other, mask=~edge), pa.array(count, mask=edge)], ["doc_id", "other", "links"])


def _compare_cell(texts: list[str], ids: np.ndarray, times: np.ndarray, hot: np.ndarray, bucket: int, own: np.ndarray | None, n: int, threshold: float) -> pa.RecordBatch:
    """All pairs of a cell; own: the block of each document, if only pairs between blocks count."""
    parts = [tv.shingles(tv.Words(texts[at : at + 500]), n) for at in range(0, len(texts), 500)]
    size = np.concatenate([np.diff(f) for _, f in parts])
    members = _Members(np.concatenate([v for v, _ in parts]), np.concatenate([[0], np.cumsum(size)]))
    docs, every = len(texts), np.arange(len(texts))
    sign = int(np.flatnonzero((hot == bucket).all(axis=0))[0])
    links = np.zeros(docs, np.int64)
    forest: list[tuple[int, int]] = []
    step = max(1, min(512, 8_000_000 // docs))
    for at in range(0, docs, step):
        rows = every[at : at + step]
        both = members.shared(rows)
        near = both >= (threshold - 1e-12) * (size[rows][:, None] + size[None, :] - both)
        near &= rows[:, None] < every[None, :]
        if own is not None:
            near &= own[rows][:, None] != own[None, :]
        for i in range(sign):  # pairs that share an earlier sign's bucket are counted there
            near &= (hot[rows, i][:, None] != hot[None, :, i]) | (hot[rows, i] == 0)[:, None]
        r, c = np.nonzero(near)
        links += np.bincount(rows[r], times[c], minlength=docs).astype(np.int64) + np.bincount(c, times[rows[r]], minlength=docs).astype(np.int64)
        forest = _forest(docs, np.concatenate([rows[r], [x for x, _ in forest]]).astype(np.int64), np.concatenate([c, [x for _, x in forest]]).astype(np.int64))
    return _found(ids, links, forest)


def _verify_hot(n: int, threshold: float) -> Callable:
    """Compare the documents of cells; rows come sorted by bucket and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple[int, int, int] = (0, 0, 0)
        held: dict[int, tuple] = {}

        def compare() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                texts, hot, times, own = zip(*held.values(), strict=True)
                yield _compare_cell(list(texts), np.array(list(held), np.int64), np.array(times, np.int64), np.array(hot, np.int32), cell[0], None if cell[1] == cell[2] else np.array(own), n, threshold)
                tv.release()

        for batch in batches:
            for bucket, x, y, own, doc, hot, times, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "x", "y", "own", "doc_id", "hot", "times", "text")), strict=True):
                if (bucket, x, y) != cell:
                    yield from compare()
                    cell, held = (bucket, x, y), {}
                held[doc] = text, hot, times, own
        yield from compare()

    return run


def _split(key: np.ndarray, doc: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, keys, sides) of entries whose lists are cut into so many blocks: one entry for each
    cell of two blocks; side 0 pairs with all of its cell, sides 1 and 2 with each other."""
    own = (tv.mix64(doc.view(np.uint64)) % lists.astype(np.uint64)).astype(np.int64)
    row, other = np.repeat(np.arange(len(key)), lists), tv.ranges(np.zeros(len(key), np.int64), lists)
    own = own[row]
    low, high = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
    whole = lists[row] == 1
    cell = np.where(whole, key[row], tv.mix64(key[row] ^ tv.mix64(low << np.uint64(32) | high)) >> np.uint64(24))
    return row, cell, np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.uint8)


def _prefixes(n: int, threshold: float, ranges: int, sent: object) -> Callable:
    """Map side of the join: each document's adaptive prefix, in blocks by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (often_key, often_df, rare), buckets = sent.value
        level = np.minimum(np.log2(np.maximum(often_df, 1)) * 8, 254).astype(np.uint64) + np.uint64(1)
        df_of_level = np.concatenate([[1.0 + rare], 2 ** (np.arange(255) / 8)])
        held: list[tuple[np.ndarray, ...]] = []
        of_docs: list[tuple[np.ndarray, ...]] = []  # what all entries of a document share

        def flush() -> Iterator[pa.RecordBatch]:
            key, entry, need = (np.concatenate(x) for x in zip(*held, strict=True))
            doc, size, hot = (np.concatenate(x) for x in zip(*of_docs, strict=True))
            held.clear()
            of_docs.clear()
            order = np.argsort(key, kind="stable")
            key, entry, need = key[order], entry[order], need[order]
            del order
            cuts = _by_range(key, ranges)
            out: list[list] = [[], [], [], [], [], []]
            last = 0
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    mine = entry[a:b]
                    signs = _pack(hot[mine].ravel()) if hot[mine].any() else b""
                    for k, x in enumerate((i, _pack(np.diff(key[a:b], prepend=np.uint64(0))), _pack(doc[mine]), _pack(size[mine]), _pack(need[a:b]), signs)):
                        out[k].append(x)
                if b - last > BATCH_ENTRIES or b == len(key) and b > last:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], ["part", "key", "doc", "size", "need", "hot"])
                    out, last = [[], [], [], [], [], []], b

        total = docs = 0
        for ids, value, first in _sets(batches, n):
            hot = _look_up(_signs(value, first), buckets)
            at = np.searchsorted(often_key, value >> _TOP)
            at[at == len(often_key)] = 0
            often = often_key[at] == value >> _TOP if len(often_key) else np.zeros(len(value), bool)
            rank = np.where(often, level[at], np.uint64(0)) if len(often_key) else np.zeros(len(value), np.uint64)
            order = rank << np.uint64(56) | value
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                order[a:b].sort()
            cost = np.concatenate([[0.0], np.cumsum(df_of_level[(order >> np.uint64(56)).astype(np.int64)])])
            size = np.diff(first)
            must = np.ceil(threshold * size - 1e-9).astype(np.int64)
            best, need = np.full(len(size), np.inf), np.ones(len(size), np.int64)
            for more in EXTENSIONS:
                length = np.minimum(size - must + more, size)
                pairs = cost[first[:-1] + length] - cost[first[:-1]] - length
                spent = length + pairs + VERIFY_COST * pairs / more
                better = (spent < best) & (more <= np.maximum(must, 1))
                best, need = np.where(better, spent, best), np.where(better, more, need)
            length = np.where(size > 0, np.minimum(size - must + need, size), 0)
            pick = tv.ranges(first[:-1], length)
            key = (order[pick] & np.uint64((1 << 56) - 1)) >> _TOP
            row = np.repeat(np.arange(len(ids), dtype=np.int32), length)
            side = np.zeros(len(key), np.uint8)
            lists = -(-df_of_level[(order[pick] >> np.uint64(56)).astype(np.int64)] // LIST_ROWS).astype(np.int64)
            if (lists > 1).any():
                entry, key, side = _split(key, ids[row], lists)
                row = row[entry]
            held.append((key, row + np.int32(docs), need[row].astype(np.uint8) | side << np.uint8(6)))
            of_docs.append((ids, size.astype(np.int32), hot))
            total += len(key)
            docs += len(ids)
            if total > _FLUSH:
                total = docs = 0
                yield from flush()
        if total:
            yield from flush()

    return run


def _count(a: np.ndarray, b: np.ndarray, need: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((b, a))
    a, b, need, n = a[order], b[order], need[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[at], b[at], np.maximum.reduceat(need, at) if len(at) else need, np.add.reduceat(n, at).astype(np.int32) if len(at) else n


def _lists(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """The posting lists of a range, each sorted by size: (key, doc, size, need, side, hot); lists of one are left out."""
    held = []
    for batch in batches:
        for raw in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "size", "need", "hot")), strict=True):
            key, doc, size, need = (_unpack(x, kind) for x, kind in zip(raw, (np.uint64, np.int64, np.int32, np.uint8), strict=False))
            held.append((np.cumsum(key), doc, size, need, _unpack(raw[4], np.int32).reshape(-1, SIGNS) if raw[4] else None))
    if not held:
        return None
    key, doc, size, need = (np.concatenate([x[k] for x in held]) for k in range(4))
    hot = np.concatenate([np.zeros((len(x[0]), SIGNS), np.int32) if x[4] is None else x[4] for x in held]) if any(x[4] is not None for x in held) else None
    held.clear()
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    order = order[~(new & np.append(new[1:], True))]
    order = order[np.lexsort((size[order], key[order]))]
    return key[order], doc[order], size[order], need[order] & np.uint8(63), need[order] >> np.uint8(6), None if hot is None else hot[order]


def _candidates(threshold: float) -> Callable:
    """Reduce side: pairs of documents that share prefix members of this range, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _lists(batches)
        tv.release()
        if found is None or not len(found[0]):
            return
        key, doc, size, need, side, hot = found
        # Within a list sorted by size, the partners of a row are a run that begins just after it.
        end = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        group = np.repeat(np.arange(len(end)), np.diff(end, prepend=0)).astype(np.int64)
        scale = int(size.max()) + 2
        partners = np.searchsorted(group * scale + size, group * scale + np.minimum((size / threshold + 1e-9).astype(np.int64), scale - 1), side="right")
        index = np.arange(len(key))
        count = np.maximum(partners - index - 1, 0)
        del group, key
        done = np.cumsum(count)
        rest: list[tuple[np.ndarray, ...]] = []

        def counted() -> Iterator[pa.RecordBatch]:
            out = _count(*(np.concatenate(x) for x in zip(*rest, strict=True))) if len(rest) > 1 else rest[0]
            rest.clear()
            for at in range(0, len(out[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in out], ["a", "b", "need", "n"])

        begin = 0
        while begin < len(count):
            stop = max(begin + 1, int(np.searchsorted(done, (done[begin - 1] if begin else 0) + _FLUSH, side="right")))
            left = np.repeat(index[begin:stop], count[begin:stop])
            right = tv.ranges(index[begin:stop] + 1, count[begin:stop])
            begin = stop
            keep = (doc[left] != doc[right]) & ((side[left] == 0) | (side[left] != side[right]))
            if hot is not None:
                for i in range(SIGNS):  # those are compared in their hot bucket
                    keep &= (hot[left, i] != hot[right, i]) | (hot[left, i] == 0)
            left, right = left[keep], right[keep]
            a, b = doc[left], doc[right]
            rest.append(_count(np.minimum(a, b), np.maximum(a, b), np.minimum(need[left], need[right]).astype(np.int32), np.ones(len(a), np.int32)))
            if sum(len(x[0]) for x in rest) > HELD_PAIRS:
                yield from counted()
        if rest:
            yield from counted()

    return run


def _verify(n: int, threshold: float) -> Callable:
    """Compare the sets of candidates; rows come sorted by cell, texts and pairs of a cell together."""

    def compare(texts: dict[int, tuple[str, int]], pairs: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
        ids = np.array(list(texts), np.int64)
        number, times = {x: i for i, x in enumerate(texts)}, np.array([t for _, t in texts.values()], np.int64)
        sets: list[np.ndarray] = []
        for at in range(0, len(ids), 500):
            value, first = tv.shingles(tv.Words([texts[x][0] for x in ids[at : at + 500].tolist()]), n)
            sets += [value[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        links = np.zeros(len(ids), np.int64)
        near_a, near_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for doc, others in pairs.items():
            a = number[doc]
            mine = sets[a]
            for at in range(0, len(others), 2000):
                some = np.array([number[x] for x in others[at : at + 2000]])
                sizes = np.array([len(sets[b]) for b in some])
                other = np.concatenate([sets[b] for b in some])
                place = np.searchsorted(mine, other)
                place[place == len(mine)] = 0
                both = np.add.reduceat((mine[place] == other).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                near = some[both / (len(mine) + sizes - both) >= threshold - 1e-12]
                links[a] += times[near].sum()
                links[near] += times[a]
                near_a.append(np.full(len(near), a))
                near_b.append(near)
        yield _found(ids, links, _forest(len(ids), np.concatenate(near_a), np.concatenate(near_b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, tuple[str, int]] = {}
        pairs: dict[int, list[int]] = {}
        size, last = 0, None
        for batch in batches:
            for key, cell, a, b, times, text in zip(*(batch.column(c).to_pylist() for c in ("key", "cell", "a", "b", "times", "text")), strict=True):
                if (key, cell) != last:
                    if size > tv.BATCH_CHARS:
                        yield from compare(texts, pairs)
                        texts, pairs, size = {}, {}, 0
                    last = key, cell
                if b is None:
                    texts[a] = text, times
                    size += len(text)
                else:
                    pairs.setdefault(a, []).append(b)
        if texts:
            yield from compare(texts, pairs)
        tv.release()

    return run


def _one_text(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) with one text for each doc_id, rows may repeat; (doc_id, sum) of these."""
    plain = identified(docs, "text").where("text IS NOT NULL AND text != ''").withColumn("sum", F.unhex(F.md5("text")))
    known = settle(plain.groupBy("doc_id").agg(F.min("sum").alias("sum"), F.max("sum").alias("last")))
    several = settle(known.where("sum != last").select(F.col("doc_id").alias("own"), F.col("sum").alias("least")))
    if several.limit(1).count():
        plain = plain.join(small(several), (F.col("doc_id") == F.col("own")) & (F.col("sum") != F.col("least")), "left_anti")
    return plain.select("doc_id", "text"), known.select("doc_id", "sum")


def _candidate_links(single: DataFrame, times: DataFrame, sent: object, n: int, threshold: float) -> DataFrame:
    """What the prefix join finds and verification confirms, as _FOUND."""
    ranges = RANGES * partitions(single.sparkSession)
    counted = settle(
        single.mapInArrow(_prefixes(n, threshold, ranges, sent), "part int, key binary, doc binary, size binary, need binary, hot binary")
        .repartitionById(ranges, "part")
        .mapInArrow(_candidates(threshold), "a long, b long, need int, n int")
        .groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
        .where("n >= need").select("a", "b")
    )
    # A document's key is the lowest id among its candidates and itself, so that alike documents meet once.
    ends = counted.select("b", "a").union(counted.select(F.col("a").alias("b"), F.col("a")))
    keys = ends.groupBy("b").agg(F.min("a").alias("key")).withColumnRenamed("b", "a")
    pairs = settle(counted.join(keys, "a").select("key", "a", "b"))
    large = settle(pairs.groupBy("key").count().where(F.col("count") > CELL_PAIRS).select("key", F.ceil(F.sqrt(F.col("count") / CELL_PAIRS)).alias("blocks")))
    block = lambda c: F.pmod(F.xxhash64(c), F.coalesce("blocks", F.lit(1)))
    pairs = settle(pairs.join(small(large), "key", "left").select("key", F.expr("coalesce(blocks, 1)").alias("blocks"), "a", "b").withColumn("cell", (block("a") * F.col("blocks") + block("b")).cast("int")).drop("blocks"))
    wanted = settle(pairs.select("key", "cell", "a").union(pairs.select("key", "cell", "b")).distinct().withColumnRenamed("a", "doc_id"))
    texts = single.join(small(wanted), "doc_id").join(small(times), "doc_id", "left").select("key", "cell", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), F.coalesce("times", F.lit(1)).alias("times"), "text")
    rows = texts.unionByName(pairs, allowMissingColumns=True)
    return rows.repartition(ranges, "key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_verify(n, threshold), _FOUND)


def _hot_links(single: DataFrame, times: DataFrame, signs: DataFrame, sent: object, n: int, threshold: float) -> DataFrame:
    """What comparison within the hot buckets finds, as _FOUND."""
    cells = settle(signs.mapInArrow(_cells(sent), "bucket int, x int, y int, own int, doc_id long, hot array<int>"))
    rows = single.join(small(cells, 300_000), "doc_id").join(small(times), "doc_id", "left").withColumn("times", F.coalesce("times", F.lit(1)))
    return rows.repartition(RANGES * partitions(single.sparkSession), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(_verify_hot(n, threshold), _FOUND)


def near_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) of every document: what links connect has the class of its lowest
    doc_id; links counts the other documents whose Jaccard index with this one is threshold or more."""
    context = docs.sparkSession.sparkContext
    texts, known = _one_text(docs)
    leads = settle(known.groupBy("sum").agg(F.min("doc_id").alias("lead"), F.count("*").alias("times")).where("times > 1"))
    copies = settle(known.join(small(leads, 1_000_000), "sum").select("doc_id", "lead", "times"))
    single = without(texts, copies.where("doc_id != lead").select("doc_id"))
    times = settle(leads.select(F.col("lead").alias("doc_id"), "times"))
    often = _hot(single, n)
    signs, value, size = _buckets(single, n)
    found = _candidate_links(single, times, context.broadcast((often, value)), n, threshold)
    if len(value):
        found = found.unionByName(_hot_links(single, times, signs.dropDuplicates(["doc_id"]), context.broadcast((value, size)), n, threshold))
    found = settle(found)
    classes = groups(found.where("other IS NOT NULL").select(F.col("doc_id").alias("doc_id_a"), F.col("other").alias("doc_id_b")))
    links = found.where("other IS NULL").groupBy("doc_id").agg(F.sum("links").alias("found")).join(classes, "doc_id", "left").select(F.col("doc_id").alias("lead"), "found", "group")
    every = identified(docs).distinct().join(small(copies), "doc_id", "left").withColumn("lead", F.coalesce("lead", "doc_id"))
    return every.join(small(settle(links)), "lead", "left").select("doc_id", F.coalesce("group", "lead").alias("class_id"), (F.coalesce("found", F.lit(0)) + F.coalesce("times", F.lit(1)) - 1).alias("links"))


def groups(pairs: DataFrame) -> DataFrame:
    """Connected components of (doc_id_a, doc_id_b): rows (doc_id, group), the group's lowest doc_id.

    Lowest labels spread along edges and along labels (pointer jumping), a
    shuffle each, until nothing changes; every round is checkpointed.
    """
    edges = pairs.select(F.col("doc_id_a").alias("x"), F.col("doc_id_b").alias("y")).where("x != y")
    edges = settle(edges.union(edges.select("y", "x")).distinct())
    label = settle(edges.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("group")))
    while True:
        near = edges.join(label.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("group").alias("near"))
        step = label.join(near, "x").select("x", F.least("group", "near").alias("to"), "group")
        jump = label.select(F.col("x").alias("to"), F.col("group").alias("further"))
        new = settle(step.join(jump, "to", "left").select("x", F.least("to", F.coalesce("further", "to")).alias("now"), "group"))
        changed = new.where("now != group").limit(1).count()
        label = new.select("x", F.col("now").alias("group"))
        if not changed:
            return label.withColumnRenamed("x", "doc_id")


def drop_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs but for all except the lowest doc_id of each class of near copies.

    Rows that repeat a doc_id are reduced to one (the least text that is not
    null, then the least of the other columns that have an order); rows without
    doc_id stay.
    """
    kept = without(docs, near_classes(docs, n, threshold).where("doc_id != class_id").select("doc_id"))
    again = settle(identified(docs).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not again.limit(1).count():
        return kept
    once = without(kept, again, "left_semi")
    ordered = [named(f.name) for f in docs.schema if f.name not in ("doc_id", "text") and isinstance(f.dataType, AtomicType)]
    least = once.groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(named(c)).alias(f"c{i}") for i, c in enumerate(docs.columns))), F.struct(F.col("text").isNull(), "text", *ordered)).alias("row"))
    once = least.select(*(F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)))
    return without(kept, again).unionByName(once)
