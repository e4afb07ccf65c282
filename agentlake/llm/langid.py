"""Operator 6: word-first language identification with character n-gram backoff.

A known word counts with its log frequency in every language.  An unseen word
is scored by its character n-grams (with marks for the word's begin and end):
the longest length at which any of them is known, 5 down to 1, gives the mean
log frequency.  A document's score in a language is the sum over its words.

The model is fitted on about FIT_DOCS labelled documents of each language,
picked by a hash of doc_id; its tables hold every word and n-gram of these, and go to
the executors in one broadcast, whose size FIT_DOCS bounds.
Documents are scored where they lie: one scan, no shuffle, numpy over whole
batches.

Defined results: a null or empty text, one without words, one of whose words
nothing is known, and one whose best language leads the second by less than
MIN_LEAD (natural log, whole text) gets language 'und' (undetermined); ties go
to the language that sorts first and are 'und' for lack of a lead.  Rows with a
null label do not take part in the fit; rows without doc_id are scored in
place by ``keep_determined`` and left out by ``identify``; repeated rows are
scored each; other columns do not matter; without labelled rows every document
is 'und'; with one language only there is no second, and any evidence decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import textvec as tv
from .common import identified, in_small_batches

FIT_DOCS, MIN_LEAD, LONGEST = 1000, 0.01, 5
_SMOOTH = 0.1
_BEGIN, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _grams(words: tv.Words, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of the words at ``which`` and how many each has."""
    start, end = words.start[which], words.end[which]
    count = np.maximum(end - start - n + 1, 0)
    at = tv.ranges(start, count)
    h = words.span_hash(at, at + n)
    h ^= np.where(at == np.repeat(start, count), _BEGIN, np.uint64(0))
    h ^= np.where(at + n == np.repeat(end, count), _END, np.uint64(0))
    return tv.mix64(h ^ np.uint64(n)), count


def _count_model(languages: list[str]) -> Callable:
    """Counts of words (order 0) and n-grams (their length) by language."""
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices(batch):
                words = tv.Words(part.column("text").to_pylist())
                lang = np.array([number[x] for x in part.column("lang").to_pylist()])[words.doc_of_word()]
                for i in np.unique(lang).tolist():
                    mine = np.flatnonzero(lang == i)
                    h, first, count = np.unique(words.hash[mine], return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"kind": np.zeros(len(h), np.int32), "hash": tv.signed(h), "lang": np.full(len(h), i, np.int32), "n": count})
                    for n in range(1, LONGEST + 1):
                        gram, per = _grams(words, mine[first], n)
                        g, back = np.unique(gram, return_inverse=True)
                        weight = np.bincount(back, np.repeat(count, per), minlength=len(g)).astype(np.int64)
                        yield pa.RecordBatch.from_pydict({"kind": np.full(len(g), n, np.int32), "hash": tv.signed(g), "lang": np.full(len(g), i, np.int32), "n": weight})

    return run


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[list[str], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(languages, {0 for words or n-gram length: (sorted hashes, log frequency by language)})."""
    labelled = identified(docs, F.col("lang").cast("string").alias("lang"), "text").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return [], {}
    rate = F.create_map(*(F.lit(x) for k in languages for x in (k, int(min(1.0, fit_docs / sizes[k]) * (1 << 30)))))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate[F.col("lang")])
    counts = chosen.mapInArrow(_count_model(languages), "kind int, hash long, lang int, n long").groupBy("kind", "hash").agg(
        *(F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(languages)))
    )
    rows = counts.toArrow()
    kind, hashes = rows.column("kind").to_numpy(), rows.column("hash").to_numpy().view(np.uint64)
    n = np.stack([rows.column(f"n{i}").to_numpy() for i in range(len(languages))], axis=1).astype(np.float64)
    model = {}
    for k in range(LONGEST + 1):
        mine = np.flatnonzero(kind == k)
        mine = mine[np.argsort(hashes[mine])]
        if len(mine):
            total = n[mine].sum(axis=0) + _SMOOTH * len(mine)
            model[k] = hashes[mine], np.log((n[mine] + _SMOOTH) / total).astype(np.float32)
    return languages, model


def _look_up(table: tuple[np.ndarray, np.ndarray] | None, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are known, and the place of each."""
    if table is None:
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.searchsorted(table[0], h)
    at[at == len(table[0])] = 0
    return table[0][at] == h, at


def score(words: tv.Words, languages: int, model: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Summed log frequencies [document, language], and the number of words with evidence."""
    total = np.zeros((len(words.hash) + 1, languages))
    known, at = _look_up(model.get(0), words.hash)
    if known.any():
        total[1:][known] = model[0][1][at[known]]
    pending = np.flatnonzero(~known)
    for n in range(LONGEST, 0, -1):
        if not len(pending) or n not in model:
            continue
        gram, count = _grams(words, pending, n)
        hit, at = _look_up(model[n], gram)
        owner = np.repeat(np.arange(len(pending)), count)[hit]
        hits = np.bincount(owner, minlength=len(pending))
        found = hits > 0
        values = model[n][1][at[hit]]
        for i in range(languages):
            total[1:, i][pending[found]] = np.bincount(owner, values[:, i], minlength=len(pending))[found] / hits[found]
        known[pending[found]] = True
        pending = pending[~found]
    np.cumsum(total, axis=0, out=total)
    evidence = np.concatenate([[0], np.cumsum(known)])
    return total[words.first[1:]] - total[words.first[:-1]], evidence[words.first[1:]] - evidence[words.first[:-1]]


def decide(scores: np.ndarray, evidence: np.ndarray, min_lead: float) -> tuple[np.ndarray, np.ndarray]:
    """(number of the language or -1, lead over the second) of each document."""
    if not scores.shape[1]:
        return np.full(len(scores), -1), np.zeros(len(scores))
    best = scores.argmax(axis=1)
    if scores.shape[1] == 1:
        return np.where(evidence > 0, 0, -1), np.zeros(len(scores))
    ordered = np.sort(scores, axis=1)
    lead = ordered[:, -1] - ordered[:, -2]
    return np.where((evidence > 0) & (lead >= min_lead), best, -1), lead


def _judge(model: object, min_lead: float, carried: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, tables = model.value
        names = [*languages, "und"]
        for batch in batches:
            for part in tv.slices(batch):
                words = tv.Words(part.column("text").to_pylist())
                which, lead = decide(*(found := score(words, len(languages), tables)), min_lead)
                new = [pa.array([names[i] for i in which.tolist()], pa.string()), pa.array(lead, pa.float64()), pa.array(np.diff(words.first), pa.int64()), pa.array(found[1], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *new], [*carried, "language", "lead", "words", "scored_words"])

    return run


def identify(docs: DataFrame, min_lead: float = MIN_LEAD, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, language, lead, words, scored_words) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, fit_docs))
    return identified(docs, "text").mapInArrow(_judge(model, min_lead, ["doc_id"]), "doc_id long, language string, lead double, words long, scored_words long")


def keep_determined(docs: DataFrame, min_lead: float = MIN_LEAD, fit_docs: int = FIT_DOCS) -> DataFrame:
    """The rows of docs whose language is determined, with it in column ``lang``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, fit_docs))
    place, texts = docs.columns.index("lang"), docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # mapInArrow takes no names with dots
    schema = StructType([StructField(f.name, StringType()) if i == place else f for i, f in enumerate(plain.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, tables = model.value
        for batch in batches:
            for part in tv.slices(batch, f"c{texts}"):
                which = decide(*score(tv.Words(part.column(texts).to_pylist()), len(languages), tables), min_lead)[0]
                found = pa.array([languages[i] if i >= 0 else None for i in which.tolist()], pa.string())
                yield part.set_column(place, f"c{place}", found).filter(pa.array(which >= 0))

    return in_small_batches(plain).mapInArrow(run, schema).toDF(*docs.columns)
