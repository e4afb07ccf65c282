"""Vectors: exact k-nearest search, bookkeeping and embedding providers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x))


def normalise(v: Column) -> Column:
    """To length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double")))


def add(vectors: DataFrame, new: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(vectors with the rows of new in place of older ones, rejected rows of another dimension); new has ``position``."""
    fits = F.coalesce(F.size("embedding") == dimension, F.lit(False))
    latest = new.where(fits).withColumn("_n", F.row_number().over(Window.partitionBy("message_id").orderBy(F.desc("position")))).where("_n = 1")
    kept = vectors.join(latest.select("message_id"), "message_id", "left_anti")
    return kept.unionByName(latest.select(*vectors.columns)), new.where(~fits)


def search(vectors: DataFrame, query: list[float], limit: int = 10, threshold: float = 0.0, exclude: list[object] | None = None, key: str = "message_id") -> DataFrame:
    """The nearest by Euclidean distance, filters first; score = exp(-distance), at least threshold."""
    rows = vectors.where(~F.col(key).isin(exclude)) if exclude else vectors
    target = F.array(*(F.lit(float(x)) for x in query))
    best = rows.withColumn("distance", l2(F.col("embedding"), target)).orderBy("distance", key).limit(limit)
    return best.select(key, "distance", F.exp(-F.col("distance")).alias("score")).where(F.col("score") >= threshold)


#: Distances that a worker holds at once, and candidates whose distances are worked out exactly at once.
CELLS, EXACT_ROWS = 2_000_000, 16_384


def _distances(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of rows i of q and j of x from the differences themselves, so that equal vectors tie."""
    out = np.empty(len(i))
    for a in range(0, len(i), EXACT_ROWS):
        own = slice(a, a + EXACT_ROWS)
        out[own] = np.sqrt(((q[i[own]].astype(np.float64) - x[j[own]]) ** 2).sum(1))
    return out


def _merge(best: list[np.ndarray], rows: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int) -> None:
    """Candidates of queries (rows of best) put into best, which has the k nearest found so far by distance and id; unused places are infinite."""
    near, found = best
    touched, at = np.unique(rows, return_inverse=True)
    at = np.concatenate([np.repeat(np.arange(len(touched)), k), at])
    d, f = np.concatenate([near[touched].ravel(), distance]), np.concatenate([found[touched].ravel(), ids])
    order = np.lexsort((f, d, at))
    at, d, f = at[order], d[order], f[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    kept = place < k
    near[touched[at[kept]], place[kept]], found[touched[at[kept]], place[kept]] = d[kept], f[kept]


def _nearest(sent: object, k: int, key: str) -> Callable:
    def run(batches: object) -> object:
        import pyarrow as pa

        ids, q = sent.value
        best = [np.full((len(ids), k), np.inf), np.zeros((len(ids), k), dtype=np.int64)]
        q2 = np.concatenate([(q[a : a + 8_192].astype(np.float64) ** 2).sum(1) for a in range(0, len(q), 8_192)])
        for batch in batches:
            for start in range(0, batch.num_rows, 8_192):
                part = batch.slice(start, 8_192)
                own = part.column(key).to_numpy(zero_copy_only=False)
                x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                x2 = (x**2).sum(1)
                longest = x2[np.isfinite(x2)].max(initial=0)
                step = max(1, CELLS // len(own))
                for a in range(0, len(ids), step):
                    some = slice(a, a + step)
                    d = q[some].astype(np.float64) @ x.T
                    d *= -2
                    d += q2[some, None]
                    d += x2
                    d[ids[some, None] == own] = np.inf
                    # squares from products are off by a rounding: what is within it of the k-th is worked out exactly
                    slack = 1e-11 * (q2[some] + longest)
                    most = best[0][some, k - 1] ** 2
                    if len(own) > k and np.isinf(most).any():
                        most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
                    i, j = np.nonzero((d <= (most + slack)[:, None]) & (d < np.inf))
                    for c in range(0, len(i), 20 * EXACT_ROWS):
                        ii, jj = i[c : c + 20 * EXACT_ROWS], j[c : c + 20 * EXACT_ROWS]
                        _merge(best, ii + a, own[jj], _distances(q[some], x, ii, jj), k)
        for a in range(0, len(ids), 8_192):
            near, found = (x[a : a + 8_192] for x in best)
            fine = np.isfinite(near).ravel()
            yield pa.RecordBatch.from_pydict({"query_id": np.repeat(ids[a : a + 8_192], k)[fine], "found_id": found.ravel()[fine], "distance": near.ravel()[fine]})

    return run


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", at_once: int = 50_000) -> DataFrame:
    """(query_id, found_id, distance, rank) for many queries at once, a query never finding itself.

    About ``at_once`` queries go to every partition, which returns its k best for each;
    so k rows a query and partition are shuffled, not vectors.  More queries are searched
    in slices, a scan each.  A worker holds its queries, a batch of vectors and CELLS
    distances between them, whatever the number of vectors.
    """
    slices = max(1, -(-queries.count() // at_once))
    own = vectors.select(F.col(key).cast("long").alias(key), "embedding")
    best = vectors.sparkSession.createDataFrame([], "query_id long, found_id long, distance double")
    for i in range(slices):
        part = queries.where(F.pmod(F.xxhash64(key), F.lit(slices)) == i) if slices > 1 else queries
        rows = part.select(F.col(key).cast("long").alias(key), "embedding").toArrow().combine_chunks()
        if rows.num_rows:
            q = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            sent = vectors.sparkSession.sparkContext.broadcast((rows.column(key).to_numpy(), q))
            best = best.unionByName(own.mapInArrow(_nearest(sent, k, key), "query_id long, found_id long, distance double"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "found_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k)


def stats(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("provider").agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dimension")).orderBy(F.desc("vectors"), "provider")


def missing(messages: DataFrame, vectors: DataFrame, rebuild: bool = False) -> DataFrame:
    """Messages without a vector, newest first (all of them for a rebuild)."""
    rows = messages if rebuild else messages.join(vectors.select("message_id"), "message_id", "left_anti")
    return rows.orderBy(F.desc("created_at"), "message_id")


SCHEMA = "message_id string, embedding array<double>, provider string, version string, created_at long"


def initialise(spark: object, path: str) -> DataFrame:
    """The table of vectors at a path, made empty if it is not there."""
    if not is_available(spark, path):
        spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def is_available(spark: object, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def has_embedding(vectors: DataFrame, ids: DataFrame, key: str = "message_id") -> DataFrame:
    """ids with whether each has a vector."""
    known = vectors.select(key).distinct().withColumn("_known", F.lit(True))
    return ids.join(known, key, "left").withColumn("has_embedding", F.coalesce("_known", F.lit(False))).drop("_known")


def get_embedding(vectors: DataFrame, value: object, key: str = "message_id") -> list[float] | None:
    row = vectors.where(F.col(key) == value).select("embedding").first()
    return list(row["embedding"]) if row else None


def delete_embeddings(vectors: DataFrame, ids: DataFrame, key: str = "message_id") -> DataFrame:
    return vectors.join(ids.select(key).distinct(), key, "left_anti")


def find_similar(vectors: DataFrame, value: object, limit: int = 10, threshold: float = 0.0, key: str = "message_id") -> DataFrame:
    """The nearest to a stored vector, which is left out; an unknown one is an error."""
    own = get_embedding(vectors, value, key)
    if own is None:
        raise KeyError(f"no vector for {value}")
    return search(vectors, own, limit, threshold, [value], key)


def search_by_text(vectors: DataFrame, text: str, generator: EmbeddingGenerator, provider: str = "mock", limit: int = 10, threshold: float = 0.0, key: str = "message_id") -> DataFrame:
    """Embed the text as the vectors were, then search."""
    return search(vectors, generator.embed([text], provider)[0], limit, threshold, None, key)


def rebuild(messages: DataFrame, vectors: DataFrame, generator: EmbeddingGenerator, provider: str = "mock", all_: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vectors of messages that had none, or of all; counts: done and failed, a text that no vector comes of)."""
    made = missing(messages, vectors, all_).select("message_id", generator.column(F.col("content"), provider).alias("embedding"))
    counts = made.agg(F.count_if(F.size("embedding") > 0).alias("done"), F.count_if(F.coalesce(F.size("embedding") <= 0, F.lit(True))).alias("failed"))
    return made.where(F.size("embedding") > 0), counts


class HashProvider:
    """Deterministic vectors for tests: sines of a rolling 32-bit hash of the UTF-16 units."""

    name, dimension = "mock", 128

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            h = 0
            for unit in np.frombuffer(text.encode("utf-16-le"), "<u2").tolist():
                h = h * 31 + unit & 0xFFFFFFFF
            signed = h - (1 << 32) if h >= 1 << 31 else h
            out.append((np.sin(signed + np.arange(self.dimension)) * 0.5 + 0.5).tolist())
        return out


class EmbeddingGenerator:
    """Providers by name; texts beyond a given max_length are cut or refused, vectors normalised."""

    def __init__(self) -> None:
        self.providers: dict[str, object] = {"mock": HashProvider()}

    def register(self, provider: object) -> None:
        self.providers[provider.name] = provider

    def embed(self, texts: list[str | None], provider: str = "mock", max_length: int | None = None, truncate: bool = True, normalised: bool = True) -> list[list[float]]:
        if provider not in self.providers:
            raise ValueError(f"no such provider: {provider}")
        if max_length is not None and not truncate and any(len(t or "") > max_length for t in texts):
            raise ValueError("a text is too long")
        rows = np.array(self.providers[provider].embed([(t or "")[:max_length] for t in texts]), dtype=np.float64).reshape(len(texts), -1)
        if normalised:
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            rows = np.where(norm > 0, rows / np.where(norm > 0, norm, 1), rows)
        return rows.tolist()

    def column(self, text: Column, provider: str = "mock", max_length: int | None = None, truncate: bool = True, normalised: bool = True) -> Column:
        """Vectors of whole texts, or of their first max_length characters."""
        if provider not in self.providers:
            raise ValueError(f"no such provider: {provider}")

        @F.pandas_udf("array<double>")
        def embed(texts: pd.Series) -> pd.Series:
            return pd.Series(self.embed(texts.tolist(), provider, max_length, truncate, normalised))

        return embed(text)
