"""Operator 1: token-id shards with Elias-Fano document boundaries.

Each shard holds the ids of many documents end to end (unsigned, 2 bytes for a
vocabulary of up to 65,536, else 4, little-endian) and where each document
begins.  The n + 1 boundaries are a rising sequence: ``EliasFano`` keeps the
low bits as they are and the high bits in unary, about 2 + log2(tokens per
document) bits each, with the place of every 64th one as a 4-byte sample, so
that ``select`` finds any boundary without a table of 64-bit offsets.

Documents are encoded where they lie, in the order of the input's rows, one
scan and no shuffle; a shard is closed when it has SHARD_TOKENS tokens.

Defined results: every row has its place, also with a null doc_id (null in
``doc_ids``) and with a null or empty text (a document of no tokens); a text
is never cut, so that a very long one makes a longer shard; repeated rows are
repeated; other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import textvec as tv
from .common import in_small_batches

SHARD_TOKENS = 1 << 20
_EVERY = 64
SCHEMA = "shard long, docs long, tokens long, doc_ids array<long>, ids binary, id_bytes int, low_bits int, lows binary, highs binary, samples binary"


class EliasFano:
    """A rising sequence of integers, in near-minimal space, with select."""

    def __init__(self, count: int, low_bits: int, lows: bytes, highs: bytes, samples: bytes):
        self.count, self.low_bits = count, low_bits
        self._lows, self._highs, self._samples = lows, highs, np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        if values[0] < 0 or (np.diff(values) < 0).any():
            raise ValueError("the values must rise from 0 or more")
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        ones = (values >> low_bits) + np.arange(n)
        if ones[-1] >= 1 << 32:
            raise ValueError("too many values for 4-byte samples")
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        low = (values[:, None] >> np.arange(low_bits) & 1).astype(np.uint8)
        return cls(n, low_bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::_EVERY].astype("<u4").tobytes())

    def parts(self) -> tuple[int, bytes, bytes, bytes]:
        return self.low_bits, self._lows, self._highs, self._samples.astype("<u4").tobytes()

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        a = i * self.low_bits
        raw = int.from_bytes(self._lows[a >> 3 : (a + self.low_bits + 7) >> 3], "little")
        return raw >> (a & 7) & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The i-th value, from its sample on a few bytes further."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        place = int(self._samples[i // _EVERY])
        left = i % _EVERY
        byte = place >> 3
        word = self._highs[byte] >> (place & 7) << (place & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self._highs[byte]
        for _ in range(left):
            word &= word - 1
        high = (byte << 3) + (word & -word).bit_length() - 1 - i
        return high << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        """All values at once."""
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self._highs, np.uint8), bitorder="little"))[: self.count] - np.arange(self.count)
        low = np.unpackbits(np.frombuffer(self._lows, np.uint8), bitorder="little")[: self.count * self.low_bits].reshape(self.count, self.low_bits).astype(np.int64)
        return (high << self.low_bits) + (low << np.arange(self.low_bits)).sum(axis=1)


def _shards(vocabulary: str, shard_tokens: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoding(vocabulary).encode_ordinary
        kind = np.dtype("<u2" if bpe.encoding(vocabulary).max_token_value < 1 << 16 else "<u4")
        number = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        total = 0

        def flush() -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            low_bits, lows, highs, samples = EliasFano.of(ends).parts()
            row = {"shard": number, "docs": len(docs), "tokens": total, "doc_ids": docs, "ids": np.concatenate(ids).tobytes(), "id_bytes": kind.itemsize, "low_bits": low_bits, "lows": lows, "highs": highs, "samples": samples}
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            for part in tv.slices(batch):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    ids.append(np.array(encode(text.as_py() or ""), dtype=kind))
                    docs.append(doc)
                    total += len(ids[-1])
                    if total >= shard_tokens:
                        yield flush()
                        ids, docs, total = [], [], 0
                        number += 1
        if docs:
            yield flush()

    return run


def shards(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Token-id shards of all documents (see SCHEMA)."""
    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_shards(vocabulary, shard_tokens), SCHEMA)


def documents_of(row: object) -> list[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every document in a shard's row."""
    bounds = EliasFano(row["docs"] + 1, row["low_bits"], row["lows"], row["highs"], row["samples"]).values()
    ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}")
    return [(d, ids[a:b]) for d, a, b in zip(row["doc_ids"], bounds[:-1], bounds[1:], strict=True)]
