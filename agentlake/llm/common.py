"""Helpers shared by the operators: inputs, checkpoints, checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import settle, shared_root

__all__ = ["BROADCAST_IDS", "identified", "in_small_batches", "named", "partitions", "remove", "settle", "shared_folder", "small", "table", "unused", "without"]

#: Rows of ids that may be sent to every executor (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of a batch of rows on its way to Python.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """A settled frame, marked for broadcast if it has that many rows at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose texts go to Python BATCH_BYTES at a time: by rows alone, long texts fill the memory of both sides."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def identified(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id as a long and the given columns, without rows that have no doc_id."""
    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), *columns).where("doc_id IS NOT NULL")


def named(column: str) -> str:
    """A column's name as it may stand in an expression, whatever signs it has."""
    return "`" + column.replace("`", "``") + "`"


def unused(columns: list[str], name: str) -> str:
    """A column name that none of the columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, ids: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of docs whose doc_id is not among ids (``left_semi``: is among them); rows without doc_id are among none."""
    own = unused(docs.columns, "__own_id")
    return docs.join(small(settle(ids.select(F.col("doc_id").alias(own)))), F.col("doc_id") == F.col(own), how)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_root(spark)}/tables-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
