"""Vectorised text primitives over whole Arrow batches.

The texts of a batch are laid end to end as one array of code points, so
that cutting into words, lower-casing and hashing are a few numpy passes
over the batch and no Python runs per word.  Every document is followed by
one separator code point (a space), hence no word crosses two documents.

Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longest run of characters held as one array; documents beyond it form a batch of their own.
BATCH_CHARS = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95  # odd, 5 mod 8: invertible modulo 2**64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values into well spread ones (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + _MIX
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> lower-case code point, and -> is part of a word."""
    n = sys.maxunicode + 1
    lower = np.arange(n, dtype=np.uint32)
    word = np.zeros(n, dtype=bool)
    for c in range(0x30000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if (low := ch.lower()) != ch and len(low) == 1:
            lower[c] = ord(low)
        if unicodedata.category(ch)[0] in "LNM" or ch == "_":
            word[c] = True
    return lower, word


@functools.cache
def _char_codes() -> np.ndarray:
    """A random-looking 64-bit value for every (lower-cased) code point."""
    return mix64(_tables()[0].astype(np.uint64))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BATCH_CHARS + 1024)
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for base in (_BASE, inverse):
            out = np.ones(size, dtype=np.uint64)
            filled, step = 1, base
            with np.errstate(over="ignore"):
                while filled < size:
                    more = min(filled, size - filled)
                    out[filled : filled + more] = out[:more] * np.uint64(step)
                    filled += more
                    step = step * step & (1 << 64) - 1
            both.append(out)
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of a batch of documents, in order.

    ``start``/``end``: character positions in ``codes`` (lower-cased code
    points of all documents); ``hash``: 64-bit hash of each word; ``first``:
    index of each document's first word, with the total at the end;
    ``base``: position of each document's first character.
    """

    def __init__(self, texts: list[str | None]):
        lower, is_word = _tables()
        joined = " ".join(["" if t is None else t for t in texts]) + " "
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.codes = lower[raw]
        self.capital = self.codes != raw
        lengths = np.fromiter((0 if t is None else len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.base = np.concatenate([[0], np.cumsum(lengths + 1)])
        inside = is_word[raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        power, inverse = _powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum(_char_codes()[self.codes] * power[: len(raw)], out=self.prefix[1:])
            self._inverse = inverse
            self.hash = self.span_hash(self.start, self.end)
        self.first = np.searchsorted(self.start, self.base)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of any character spans of ``codes``."""
        with np.errstate(over="ignore"):
            return mix64((self.prefix[end] - self.prefix[start]) * self._inverse[start])

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, start: int, end: int) -> str:
        return self.codes[start:end].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word n-gram hashes (56 bits) of each document, sorted within it.

    Returns (hashes, first index of each document, total at the end).  A
    document of fewer than n words has its whole word sequence as one
    shingle; one without words has none.
    """
    count = np.diff(words.first)
    h = words.hash
    with np.errstate(over="ignore"):
        gram = np.zeros(len(h), dtype=np.uint64)
        for k in range(n):
            mult = np.uint64(pow(_BASE, 2 * k + 1, 1 << 64))
            gram[: len(h) - k] += (h[k:] ^ (h[k:] >> np.uint64(29))) * mult
    per = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    index = ranges(words.first[:-1], per)
    value = mix64(gram[index]) >> np.uint64(8)
    at = np.concatenate([[0], np.cumsum(per)])
    with np.errstate(over="ignore"):
        for d in np.flatnonzero((count > 0) & (count < n)).tolist():
            value[at[d]] = _fold(h[words.first[d] : words.first[d + 1]]) >> 8
    fresh = np.ones(len(value), dtype=bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        value[a:b].sort()
    fresh[1:] = value[1:] != value[:-1]
    fresh[at[:-1][per > 0]] = True
    return value[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def _fold(hashes: np.ndarray) -> int:
    out = len(hashes)
    for x in hashes.tolist():
        out = (out * _BASE + x) & (1 << 64) - 1
    return int(mix64(np.array([out], dtype=np.uint64))[0])


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark longs."""
    return x.view(np.int64)


@functools.cache
def _trim() -> object:
    library = ctypes.CDLL(None)
    return library.malloc_trim if hasattr(library, "malloc_trim") else lambda _: 0


def release() -> None:
    """Give freed memory back: a worker lives through many tasks, and the C library keeps what arrays of changing sizes leave."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that its texts have about BATCH_CHARS characters at most."""
    if not batch.num_rows:
        return
    column = batch.column(text)
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // BATCH_CHARS
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(int(a), int(b - a))
    release()


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + c) over all pairs."""
    counts = np.asarray(counts, dtype=np.int64)
    if not counts.sum():
        return np.zeros(0, dtype=np.int64)
    return np.repeat(np.asarray(starts) - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
