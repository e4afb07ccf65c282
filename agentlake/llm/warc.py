"""Operator 10: Merkle fixity audit of WARC replicas.

An archive is its records laid end to end; a record has its byte offset.  A leaf
is a record's SHA-256 (of header and payload) at its offset; the leaves whose
offsets lie in one range of RANGE_BYTES form a node, whose hash is that of its
leaves' offsets and hashes in order; FANOUT nodes that follow one another form a
node of the next level, up to one root.  A replica is audited by comparing roots,
and then, level by level, only the children of nodes that differ, until the
differing records are found: sound ranges are never opened.

Hashing reads every record once, in the JVM; 32 bytes and an offset of each go to
the aggregation of its range, and each level above is 1/FANOUT of the one below.
Payloads are not shuffled.  The trees are checkpointed, so that descending reads
hashes alone; the open ranges are sent to the leaves (or joined by shuffle, beyond
common.BROADCAST_IDS), so that of the leaves only those in open ranges move.

``laid_out`` gives offsets to records in the order of their numbers, by prefix sums
in two levels over a range partitioning that also cuts between equal numbers.

Defined results: null payloads and URLs hash as distinct from empty ones; rows
without number have no place, and rows without offset or hash are left out of a tree; equal
numbers follow one another in the order of their hashes; records of one offset are
one leaf of all their hashes in order, so that repeated rows must be repeated in
both; other columns do not matter; two empty replicas agree, and against an empty
one every record differs; a record that is missing on one side has a null hash there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, settle, small

RANGE_BYTES, FANOUT = 1 << 18, 64


def record(url: Column, payload: Column) -> Column:
    """A WARC response record, but for its date and id."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )
    absent = F.concat(F.when(url.isNull(), "u").otherwise(""), F.when(payload.isNull(), "p").otherwise(""))
    return F.concat(head, absent)


def laid_out(records: DataFrame) -> DataFrame:
    """records (number, hash, bytes, and others) with each one's ``offset`` in the archive."""
    parts = partitions(records.sparkSession)
    order = ["number", "hash"]
    rows = settle(records.where("number IS NOT NULL").repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sums = rows.groupBy("__part").agg(F.sum("bytes").alias("bytes")).collect()  # one row a partition
    before, at = {}, 0
    for r in sorted(sums):
        before[r["__part"]] = at
        at += r["bytes"] or 0
    begin = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("__part")] if before else F.lit(0)
    within = F.sum("bytes").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("offset", (begin + F.coalesce(within, F.lit(0))).cast("long")).drop("__part")


def _above(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.expr(f"node div {FANOUT}").alias("range"), "node", "hash")


def _joined(children: DataFrame) -> DataFrame:
    """(node, hash): of each range, of its ordered children."""
    ordered = F.array_sort(F.collect_list(F.struct("node", "hash")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), "\n")
    return children.groupBy("range").agg(F.sha2(text, 256).alias("hash")).select(F.col("range").alias("node"), "hash")


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels of (range, node, hash): leaves by offset first, one root last (none for no records)."""
    own = records.where("offset IS NOT NULL AND hash IS NOT NULL").select(F.col("offset").cast("long").alias("node"), F.col("hash").cast("string").alias("hash"))
    levels = [settle(own.select(F.expr(f"node div {RANGE_BYTES}").alias("range"), "node", "hash"))]
    while True:
        ends = levels[-1].agg(F.min("node"), F.max("node"), F.count("*")).first()
        if not ends[2] or (len(levels) > 1 and ends[0] == ends[1] == 0):
            return levels
        levels.append(settle(_above(_joined(levels[-1]))))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(offset, primary_hash, replica_hash) of every record that differs; null where it is missing.

    Both have the columns offset and hash.
    """
    a, b = tree(primary), tree(replica)
    top = max(len(a), len(b)) - 1
    none = a[0].where("false")
    open_ranges = None
    for level in range(top, -1, -1):
        one, two = (x[level] if level < len(x) else none for x in (a, b))
        if open_ranges is not None:
            one, two = (x.join(small(open_ranges), "range", "left_semi") for x in (one, two))
        if not level:  # records of one offset are one leaf
            one, two = (x.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("hash")), "+").alias("hash")) for x in (one, two))
        differing = (
            one.select("node", F.col("hash").alias("primary_hash")).join(two.select("node", F.col("hash").alias("replica_hash")), "node", "full_outer")
            .where("NOT (primary_hash <=> replica_hash)")
        )
        if level:
            open_ranges = settle(differing.select(F.col("node").alias("range")))
            if level == top and not open_ranges.limit(1).count():
                break
    else:
        return differing.select(F.col("node").alias("offset"), "primary_hash", "replica_hash")
    return none.select(F.col("node").alias("offset"), F.col("hash").alias("primary_hash"), F.col("hash").alias("replica_hash"))
