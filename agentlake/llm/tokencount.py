"""Operator 8: token counts of sections by offset-mapped attribution.

A document is encoded once and whole; every token has a span of characters
(from the lengths of the tokens in bytes).  The sections of a document are its
lines, each with the line break that ends it, so that they cover the text; or, with
``starts``, those that begin at the characters that a column of arrays names (and at 0),
which may be fields of a record laid end to end.
Token spans and sections are both in order: the interval join is two binary
searches, for whole batches at once.  A token that crosses a boundary goes, by
``rule``, to the section of its first character ('start'), to the one with most
of its characters, the earlier at a tie ('majority'), or to all of them in
proportion ('share').

One scan, no shuffle.  Defined results: a null or empty text has one section
with no tokens; an empty line is a section (its break); a line break at the end
of the text begins no further section; rows without doc_id are left out;
repeated rows are counted each; of given starts, nulls, repeated ones and ones outside of the text
begin no section; other columns do not matter; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import textvec as tv
from .common import identified, named

RULES = ("start", "majority", "share")


def token_spans(texts: list[str], vocabulary: str = bpe.VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first character, character after the last, first token of each text and the total), in the joined text."""
    encode = bpe.encoding(vocabulary).encode_ordinary
    ids = [encode(t) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    length = bpe.token_bytes(vocabulary)[np.fromiter((i for x in ids for i in x), dtype=np.int64, count=int(first[-1]))]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    end = np.cumsum(length)
    return char[end - length] if len(end) else end, char[end - 1] + 1 if len(end) else end, first


def _sections(texts: list[str], starts: list[list[int | None] | None] | None) -> tuple[np.ndarray, np.ndarray]:
    """(first character in the joined text, text) of every section: lines, or what begins at the starts."""
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    if starts is None:
        after = np.flatnonzero(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) == 10) + 1
        after = after[~np.isin(after, base[1:])]
    else:
        after = np.array([b + x for b, t, own in zip(base.tolist(), texts, starts, strict=False) for x in sorted({x for x in own or () if x is not None and 0 < x < len(t)})], np.int64)
    start = np.concatenate([base[:-1], after])
    doc = np.concatenate([np.arange(len(texts)), np.searchsorted(base, after, side="right") - 1])
    order = np.lexsort((start, doc))
    return start[order], doc[order]


def attribute(start: np.ndarray, end: np.ndarray, section: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, of them crossing a boundary) of sections that begin at ``section``, rising."""
    n = len(section)
    first = np.searchsorted(section, start, side="right") - 1
    last = np.searchsorted(section, end - 1, side="right") - 1
    crossing = np.flatnonzero(last > first)
    cross = np.bincount(first[crossing], minlength=n)
    if rule == "start" or not len(crossing):
        return np.bincount(first, minlength=n).astype(np.float64), cross
    whole = np.bincount(first[last == first], minlength=n).astype(np.float64)
    count = last[crossing] - first[crossing] + 1
    token = np.repeat(crossing, count)
    at = tv.ranges(first[crossing], count)
    limit = np.append(section, np.iinfo(np.int64).max)
    held = np.minimum(end[token], limit[at + 1]) - np.maximum(start[token], section[at])
    if rule == "share":
        return whole + np.bincount(at, held / (end[token] - start[token]), minlength=n), cross
    order = np.lexsort((at, -held, token))
    winner = order[np.concatenate([[True], token[order][1:] != token[order][:-1]])]
    return whole + np.bincount(at[winner], minlength=n), cross


def _count(vocabulary: str, rule: str, given: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                start, end, _ = token_spans(texts, vocabulary)
                section, doc = _sections(texts, part.column("starts").to_pylist() if given else None)
                # Empty texts share their place with the next one's first section; tokens go to the last that begins there.
                tokens, cross = attribute(start, end, section, rule)
                number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                chars = np.diff(np.append(section, sum(map(len, texts))))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(pa.array(doc)), "section": number.astype(np.int32), "chars": chars.astype(np.int64), "tokens": tokens, "crossing": cross.astype(np.int64)})

    return run


def section_tokens(docs: DataFrame, rule: str = "majority", vocabulary: str = bpe.VOCABULARY, starts: str | None = None) -> DataFrame:
    """(doc_id, section, chars, tokens, crossing): crossing counts tokens that begin here and end in a later section."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    own = identified(docs, "text", *([F.col(named(starts)).cast("array<int>").alias("starts")] if starts else []))
    return own.mapInArrow(_count(vocabulary, rule, starts is not None), "doc_id long, section int, chars long, tokens double, crossing long")
